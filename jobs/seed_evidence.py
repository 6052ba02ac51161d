"""Find which species of the pool a corpus of texts writes about, to choose the seeds of a run.

    python -m jobs.seed_evidence --documents DIR --species DIR --out DIR [--config FILE]

A run starts from a few seeds, named by formula and charge.  The job reads every
whole text, takes the formulas in it, and joins them by composition to the pool.
OUT/source=S holds a row for each formula that source S writes: mentions, texts,
species of that composition, and the one of the lowest energy, the seed that a
query for this formula and charge resolves to.  Formulas that the pool lacks are
there with seed -1: they show what it should be searched for next.

Every run reads all texts and replaces OUT, so it gives the same rows when it is
repeated.  --species is a table of suppliers, which stand for species; the
settings name the elements and the columns that count them.  Null texts have no
formula, a null source is a partition of its own, repeated rows count each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.operators import mentions
from fluxloom.plans import bridge
from jobs import LOG, arguments, session, settings

OUT = "formula string, n_mentions long, n_texts long, n_species long, seed int, source string"


def run(spark: SparkSession, documents: str, species: str, out: str, config: dict | None = None) -> DataFrame:
    """Evidence for each source and formula, written and read back."""
    c = settings(__file__) | (config or {})
    docs, pool = spark.read.parquet(documents), spark.read.parquet(species).selectExpr(*bridge.SPECIES)
    found = mentions.counted(docs.select("text", "source"), list(c["symbols"]), c["least_atoms"], by=["source"])
    named = mentions.with_species(found, pool, c["symbols"], c["charge"])
    # A source's rows are as many as the formulas it writes, not its mentions.
    named.repartition("source").write.partitionBy("source").mode("overwrite").parquet(out)
    done = spark.read.schema(OUT).parquet(out)
    rows, texts, with_seed, sources = done.agg(F.count("*"), F.sum("n_texts"), F.count_if(F.col("seed") >= 0), F.countDistinct("source")).first()
    LOG.info("read texts of %s and species of %s", documents, species)
    LOG.info("wrote %d formulas of %d sources to %s: found %d times in a text, %d with a seed", rows, sources, out, texts or 0, with_seed)
    return done


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job on the whole tables, twice into one fresh folder of spark.checkpoint.dir."""
    import uuid

    from fluxloom import shared

    at = f"{shared.root(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        found = run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/supplier.parquet", f"{at}/out")
    return found


_COUNT = "coalesce(list_sum(list_transform(regexp_extract_all(t, '{s}([0-9]*)', 1), lambda x: CASE WHEN x = '' THEN 1 ELSE CAST(x AS BIGINT) END)), 0)"
_TEXT = " || ".join("CASE WHEN {0} > 0 THEN '{1}' || CAST({0} AS VARCHAR) ELSE '' END".format(c, s) for s, c in (("C", "n_c"), ("H", "n_h"), ("O", "n_o"), ("S", "n_s")))
SQL = bridge.sql(f"""SELECT d.*, coalesce(p.n_species, 0) AS n_species, coalesce(p.seed, -1) AS seed FROM (
SELECT source, formula, count(*) AS n_mentions, count(DISTINCT rowid_) AS n_texts FROM (SELECT source, rowid_, {_TEXT} AS formula, n_c + n_h + n_o + n_s AS atoms FROM (
SELECT source, rowid_, {', '.join(_COUNT.format(s=s) + f' AS n_{s.lower()}' for s in 'CHOS')} FROM (
SELECT source, rowid_, unnest(list_filter(string_split_regex(text, '[^A-Za-z0-9]+'), lambda x: regexp_full_match(x, '([CHOS][0-9]{{0,4}})+'))) AS t
FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents)))) WHERE atoms >= 2 GROUP BY source, formula) d
LEFT JOIN (SELECT {_TEXT} AS formula, count(*) AS n_species, CAST(arg_min(ind, (solvation_free_energy, ind)) FILTER (charge = 0) AS INT) AS seed FROM species_b GROUP BY 1) p ON d.formula = p.formula""")


def main() -> None:
    a = arguments(__doc__, "documents", "species", "out")
    spark = session("seed-evidence")
    try:
        run(spark, a.documents, a.species, a.out, settings(__file__, a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
