"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxloom.llm import bpe, common, dac, hard_negatives, license_scan, media, packing, quality, reputation, secrets, simhash, token_counts, toxicity
from fluxloom.llm import tokenizers_ as tok


def op1_byte_bpe(spark, sf_dir):
    return bpe.digests(common.documents(spark, sf_dir), tok.vocabulary("byte_bpe_50k.tiktoken"), tok.pattern())


def op2_license_scans(spark, sf_dir):
    return license_scan.scan(common.documents(spark, sf_dir))


def op3_quality_rules(spark, sf_dir):
    return quality.judge(common.documents(spark, sf_dir))


def op4_token_counts(spark, sf_dir):
    return token_counts.count_tokens(common.documents(spark, sf_dir), tok.vocabulary("piece_bpe_32k.model"))


def op5_packing(spark, sf_dir):
    return packing.pack(common.documents(spark, sf_dir), tok.vocabulary("word_bpe_49k.json"))


def op6_simhash(spark, sf_dir):
    return simhash.components(common.documents(spark, sf_dir))


def op7_media_columns(spark, sf_dir):
    return media.digests(common.documents(spark, sf_dir))


def op8_token_ids(spark, sf_dir):
    return dac.digests(common.documents(spark, sf_dir), tok.vocabulary("byte_bpe_50k.json"))


def op9_toxicity(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    return toxicity.judge(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_secret_scans(spark, sf_dir):
    return secrets.digests(common.documents(spark, sf_dir))


def op11_hard_negatives(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(e.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


def op12_url_filters(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return reputation.judge(pages, reputation.outcomes(pages, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def queries():
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql():
    return {"op2_license_scans": license_scan.oracle_sql(), "op11_hard_negatives": hard_negatives.oracle_sql(), "op12_url_filters": reputation.oracle_sql()}
