"""State series over a stream of firings: every change of a species' count, as it happens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fluxloom import shared
from fluxloom.operators.flux import sides
from fluxloom.session import ship
from fluxloom.streaming import live

OUT = "seed long, step int, species_id int, count long, late boolean"
_STATE = "held binary"
#: What a state holds, in order of species: the last count and step of each, and the time of its last change.
_HELD = np.dtype([("species", "<i4"), ("step", "<i4"), ("count", "<i8"), ("at", "<i8")])
#: States of a seed, each of a part of its species.
SHARES = 2


def _changes(network: DataFrame, initial: DataFrame) -> DataFrame:
    """reaction_id, species_id, delta, start: what a firing changes, and the species' initial count."""
    net = sides(network).groupBy("reaction_id", "species_id").agg(F.sum(F.col("produced") - F.col("consumed")).alias("delta"))
    start = initial.groupBy("species_id").agg(F.max("count").cast("long").alias("start"))
    return net.join(start, "species_id", "left").select("reaction_id", "species_id", "delta", F.coalesce("start", F.lit(0).cast("long")).alias("start"))


def live_state(stream: DataFrame, network: DataFrame, initial: DataFrame, time: str | None = None, idle_seconds: int = 3600, late: str = "10 minutes", shares: int = SHARES) -> DataFrame:
    """seed, step, species_id, count after each step that changes it, late.

    State is a count and the last step for each seed and species; a seed has so
    many states as shares, each of a part of its species, as a state for each
    species would cost more than its firings do.  A checkpoint goes with its
    shares.  A batch's firings are taken in order of steps.  One that arrives
    after a later step has been written is late: it counts from then on, and its
    row says so; one without a step is left out.  With a column of event time,
    what has not changed for idle_seconds of it is forgotten, as seeds that have
    ended never fire again (one that does would start from its initial count), and
    firings behind the watermark are left out.
    """
    ship(stream.sparkSession)
    net = _changes(network, initial)
    if time is not None:
        stream = stream.withWatermark(time, late)
    at = F.unix_millis(F.col(time)) if time is not None else F.lit(0).cast("long")
    more = [F.col(time)] if time is not None else []
    fired = stream.select(F.col("seed").cast("long").alias("seed"), F.col("step").cast("int").alias("step"), "reaction_id", at.alias("at"), *more).join(net, "reaction_id")

    fired = fired.filter("step IS NOT NULL").withColumn("share", F.pmod("species_id", F.lit(shares)))

    def keep(held: np.ndarray, state: GroupState) -> None:
        if not len(held):
            state.remove()
            return
        state.update((held.tobytes(),))
        if time is not None:
            state.setTimeoutTimestamp(max(int(held["at"].min()) + idle_seconds * 1000, state.getCurrentWatermarkMs() + 1))

    def counted(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = np.frombuffer(bytes(state.get[0]), _HELD) if state.exists else np.empty(0, _HELD)
        if time is not None:
            held = held[held["at"] + idle_seconds * 1000 >= state.getCurrentWatermarkMs()]
        if state.hasTimedOut:
            keep(held, state)
            return
        parts = list(parts)
        species, step, delta, start, at = (np.concatenate([p[c].to_numpy() for p in parts]) for c in ("species_id", "step", "delta", "start", "at"))
        order = np.lexsort((step, species))
        species, step, delta, start, at = (x[order] for x in (species, step, delta, start, at))
        begins = lambda *columns: np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0)))
        # One row of a species and step, then one of a species.
        first, head = begins(species, step), begins(species)
        start, at = start[head], np.maximum.reduceat(at, head)
        species, step, delta = species[first], step[first], np.add.reduceat(delta, first)
        head = begins(species)
        own, n = species[head], np.diff(np.append(head, len(species)))
        place = np.searchsorted(held["species"], own)
        known = np.isin(own, held["species"])
        last, base = np.full(len(own), -1), start.copy()
        last[known], base[known] = held["step"][place[known]], held["count"][place[known]]
        total = delta.cumsum()
        counts = total - np.repeat(total[head] - delta[head] - base, n)
        new, end = np.empty(len(own), _HELD), head + n - 1
        new["species"], new["step"], new["count"], new["at"] = own, np.maximum(last, step[end]), counts[end], at
        now = np.concatenate((held[~np.isin(held["species"], own)], new))
        keep(now[np.argsort(now["species"])], state)
        yield pd.DataFrame({"seed": key[0], "step": step, "species_id": species, "count": counts, "late": step <= np.repeat(last, n)})

    kind = GroupStateTimeout.NoTimeout if time is None else GroupStateTimeout.EventTimeTimeout
    return fired.groupBy("seed", "share").applyInPandasWithState(counted, OUT, _STATE, "append", kind)


def append_series(stream: DataFrame, network: DataFrame, initial: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """live_state() without event time, appended below path; returns when no more is there.

    A batch is one sort by seed, species and step together with what the batch
    before left of each, so a seed and species costs a row and no call.  It writes
    its series as batch=<its number>/held=false and the counts after it as
    held=true, of which the last two batches' stay: a batch that is run again
    starts from the same counts and replaces its partitions.
    """
    net = _changes(network, initial)
    query = stream.writeStream.foreachBatch(lambda rows, batch: _append(rows, batch, net, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_series(spark, path: str) -> DataFrame:
    """What append_series() has written."""
    return live.read_batches(spark, path, f"{OUT}, batch long, held boolean").filter("NOT held").drop("held")


def _append(rows: DataFrame, batch: int, net: DataFrame, path: str) -> None:
    keys = ["seed", "species_id"]
    fired = rows.select(F.col("seed").cast("long").alias("seed"), F.col("step").cast("int").alias("step"), "reaction_id").filter("step IS NOT NULL").join(net, "reaction_id")
    fired = fired.select(*keys, "step", "delta", "start", F.lit(-1).alias("last"), F.lit(1).alias("fires"))
    before = live.read_batches(rows.sparkSession, f"{path}/batch={batch - 1}/held=true", OUT)
    before = before.select(*keys, "step", F.col("count").alias("delta"), F.lit(0).cast("long").alias("start"), F.col("step").alias("last"), F.lit(0).alias("fires"))
    w = Window.partitionBy(*keys).orderBy("fires", "step")
    total = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Moved once.  What is held of a key comes first, so its count and last step are the first row's.
    d = before.unionByName(fired).repartition(*keys).groupBy(*keys, "fires", "step").agg(F.sum("delta").alias("delta"), F.max("start").alias("start"), F.max("last").alias("last"))
    d = d.select(
        *keys, "step", "fires", (F.first("start").over(total) + F.sum("delta").over(total)).alias("count"),
        F.first("last").over(total).alias("last"), F.lead("fires").over(w).isNull().alias("ends"),
    )
    d = d.select("*", F.explode(F.filter(F.array(F.when(F.col("fires") == 1, F.lit(False)), F.when(F.col("ends"), F.lit(True))), lambda h: h.isNotNull())).alias("held"))
    step = F.when(F.col("held"), F.greatest("step", "last")).otherwise(F.col("step"))
    late = (F.col("step") <= F.col("last")) & ~F.col("held")
    out = d.select("seed", step.alias("step"), "species_id", "count", late.alias("late"), F.lit(batch).cast("long").alias("batch"), "held")
    out.write.partitionBy("batch", "held").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    shared.remove(f"{path}/batch={batch - 2}/held=true")
