"""Live counts over a stream of firings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fluxloom import schema as S
from fluxloom.operators.flux import sides


def firing_stream(spark: SparkSession, path: str, files_per_trigger: int = 16, schema=S.TRAJECTORIES) -> DataFrame:
    """Firings as files arrive below path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def live_firings(stream: DataFrame, key: str = "reaction_id") -> DataFrame:
    """key, firings so far; firings without a key are left out."""
    return stream.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("firings"))


def live_flux(stream: DataFrame, network: DataFrame) -> DataFrame:
    """species_id, produced, consumed, touched so far; state is one row a species."""
    s = stream.filter("reaction_id >= 0").select("reaction_id").join(sides(network), "reaction_id")
    return s.groupBy("species_id").agg(F.sum("produced").alias("produced"), F.sum("consumed").alias("consumed"), F.count("*").alias("touched"))


def windowed_firings(stream: DataFrame, time: str = "ts", width: str = "5 minutes", late: str = "10 minutes", key: str = "reaction_id") -> DataFrame:
    """Firings by event-time window, late rows dropped behind the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("firings"))


def append_batches(stream: DataFrame, make: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """make(rows) of every new batch as the partition batch=<its number> below path; returns when no more is there.

    Exactly once: a batch that ended after its write and before its commit is run
    again with the same rows and number, and replaces its partition.
    """

    query = stream.writeStream.foreachBatch(lambda rows, batch: _write_batch(make(rows), batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _write_batch(rows: DataFrame, batch: int, path: str) -> None:
    out = rows.withColumn("batch", F.lit(batch).cast("long"))
    out.write.partitionBy("batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, or an empty one where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
