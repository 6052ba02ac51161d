"""The training-data pipeline: documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns what it keeps with the
columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.llm import common, packing, quality, secrets, simhash, toxicity
from fluxloom.llm import tokenizers_ as tok


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distance doesn't reject; labels of the training folds fit it."""
    return toxicity.rejected(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the base rules and the adaptive thresholds of their language and source."""
    return quality.filtered(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    return simhash.near_dedup(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced and n_chars counted anew."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 4096 tokens."""
    return packing.pack(docs, tok.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL can't express the compression distance; tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what each keeps is written to the shared folder and read again, and goes once the next stage is written."""
    docs, read = common.documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        with common.scratch() as stay:
            docs = common.written(stage(spark, docs, sf_dir), "stage")
            stay.append(docs)
        if read is not None:
            common.drop(read)
        read = docs
    return STAGES[-1][1](spark, docs, sf_dir)
