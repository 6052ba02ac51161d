"""Keep the daily flux of every species up to date while the firing log grows.

    python -m jobs.firing_ledger --events DIR --network DIR --out DIR --checkpoint DIR [--config FILE]

A long simulation campaign appends files of firings all the time, and whoever
decides on promotions needs each species' flux by day without reading the whole
log again.  The job reads the new files alone, as a stream that ends when no more
are there (availableNow), with its checkpoint at --checkpoint:

* OUT/ledger/batch=N: what batch N adds to each day and species.  A batch that
  was cut off is run again with the same files under the same number, and
  replaces its partition, so nothing counts twice.
* OUT/daily/day=D: the sums of the ledger.  Only days that batches behind the mark
  have touched are written anew.
* OUT/mark: the last batch that OUT/daily holds, written last.  A run that stops
  before it writes the same days again.

A run without new files changes nothing.  --events holds event_id and the columns
that the settings name; a firing's reaction is its event_id modulo the network's
size.  --network is a table of parts, which stand for reactions.  Firings without
a time are kept under a null day; without an event_id they are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.operators import flux
from fluxloom.plans import bridge
from fluxloom.streaming import live
from jobs import LOG, arguments, session, settings

DAILY = "species_id int, produced long, consumed long, touched long, n_seeds long, day string"
_BATCH = "day string, species_id int, seed long, produced long, consumed long, touched long, batch long"


def additions(firings: DataFrame, network: DataFrame) -> DataFrame:
    """day, species_id, seed, produced, consumed, touched of some firings, counted before the join with the network."""
    fired = firings.filter("reaction_id IS NOT NULL").groupBy("day", "seed", "reaction_id").agg(F.count("*").alias("firings"))
    rows = flux.sides(network).join(fired, "reaction_id")
    return rows.groupBy("day", "species_id", "seed").agg(
        F.sum(F.col("produced") * F.col("firings")).alias("produced"), F.sum(F.col("consumed") * F.col("firings")).alias("consumed"), F.sum("firings").alias("touched")
    )


def daily(ledger: DataFrame) -> DataFrame:
    """One row for each day and species."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("produced", "consumed", "touched")]
    return ledger.groupBy("day", "species_id").agg(*sums, F.countDistinct("seed").alias("n_seeds"))


def run(spark: SparkSession, events: str, network: str, out: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """New files of events into the ledger and the daily sums; the daily sums as they stand then."""
    c = settings(__file__) | (config or {})
    parts = spark.read.parquet(network)
    net, size = parts.selectExpr(*bridge.NETWORK), parts.count()
    schema = spark.read.parquet(events).schema
    # A pattern that matches the path alone: the source takes a single file then, too.
    path = events.rstrip("/")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", c["files_per_batch"]).parquet(f"{path[:-1]}[{path[-1]}]")
    firings = stream.select(F.date_format(c["time"], "yyyy-MM-dd").alias("day"), F.col(c["seed"]).cast("long").alias("seed"), (F.col("event_id") % max(1, size)).alias("reaction_id"))
    at = out.rstrip("/")
    query = live.append_batches(firings, lambda rows: additions(rows, net), f"{at}/ledger", checkpoint)
    read = sum(p["numInputRows"] for p in query.recentProgress)  # of the last hundred batches
    LOG.info("read %d new firings of %s in %d batches and %d reactions of %s", read, events, sum(p["numInputRows"] > 0 for p in query.recentProgress), size, network)
    ledger = live.read_batches(spark, f"{at}/ledger", _BATCH)
    mark = live.read_batches(spark, f"{at}/mark", "batch long").agg(F.max("batch")).first()[0]
    last = ledger.agg(F.max("batch")).first()[0]
    if last is not None and (mark is None or last > mark):
        new = ledger.filter(F.col("batch") > (-1 if mark is None else mark)).select(F.col("day").alias("new")).distinct()
        touched = ledger.join(F.broadcast(new), F.col("day").eqNullSafe(F.col("new")), "left_semi")  # days: some hundred a year
        daily(touched).repartition("day").write.partitionBy("day").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{at}/daily")
        spark.range(1).select(F.lit(last).cast("long").alias("batch")).coalesce(1).write.mode("overwrite").parquet(f"{at}/mark")
        LOG.info("wrote %d days to %s/daily, up to batch %d", new.count(), at, last)
    else:
        LOG.info("nothing new; %s/daily stays as it is", at)
    return live.read_batches(spark, f"{at}/daily", DAILY)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job on the whole tables, twice into one fresh folder of spark.checkpoint.dir."""
    import uuid

    from fluxloom import shared

    at = f"{shared.root(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        found = run(spark, f"{sf_dir}/events.parquet", f"{sf_dir}/part.parquet", f"{at}/out", f"{at}/checkpoint")
    return found


SQL = bridge.sql("""SELECT CAST(CAST(e.ts AS DATE) AS VARCHAR) AS day, s.species_id, CAST(sum(s.produced) AS BIGINT) AS produced, CAST(sum(s.consumed) AS BIGINT) AS consumed,
count(*) AS touched, count(DISTINCT e.user_id) AS n_seeds FROM events e JOIN side_b s ON e.event_id % (SELECT count(*) FROM part) = s.reaction_id GROUP BY 1, 2""")


def main() -> None:
    a = arguments(__doc__, "events", "network", "out", "checkpoint")
    spark = session("firing-ledger")
    try:
        run(spark, a.events, a.network, a.out, a.checkpoint, settings(__file__, a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
