"""Stochastic simulation of a network, one group of rows a seed.

Gillespie's direct method: propensities from counts, exponential waiting times,
a reaction drawn in proportion.  Only reactions that depend on a changed species
are computed anew, and propensities are kept in blocks with their sums, so a draw
costs the square root of the network's size.  A seed's result follows from the
seed and the network alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.operators.enumeration import KEYS
from fluxloom.session import ship

#: Firings in one batch of results.
BATCH = 50_000


@dataclass(frozen=True)
class Factors:
    zero: float = 1.0
    two: float = 1.0
    duplicate: float = 0.5


def trajectory(seed: int, ids: np.ndarray, places: np.ndarray, rates: np.ndarray, start: dict[int, int], steps: int, factors: Factors) -> Iterator[tuple[int, int, float]]:
    """step, reaction_id, time of each firing until steps or until nothing can fire."""
    rng = np.random.default_rng(seed)
    count = dict(start)
    # Reactions by the species that they use, as arrays: a network's lists would take many times its size.
    first, second = places[:, 0], places[:, 1]
    own, other = np.flatnonzero(first >= 0), np.flatnonzero((second >= 0) & (second != first))
    used, user = np.concatenate([first[own], second[other]]), np.concatenate([own, other]).astype(np.int32)
    order = np.argsort(used, kind="stable")
    used, user = used[order], user[order]
    del own, other, order

    def users(s: int) -> list[int]:
        key = used.dtype.type(s)  # of another type, the whole array would be cast for each call
        return user[used.searchsorted(key) : used.searchsorted(key, side="right")].tolist()

    def propensity(i: int) -> float:
        a, b, rate = places.item(i, 0), places.item(i, 1), rates.item(i)
        n = count.get(a, 0)
        if a < 0:
            return rate * factors.zero
        if b < 0:
            return rate * n
        if a == b:
            return rate * factors.two * factors.duplicate * n * (n - 1)
        return rate * factors.two * n * count.get(b, 0)

    width = max(1, int(len(ids) ** 0.5))
    blocks = np.zeros((-(-len(ids) // width), width))
    p = blocks.reshape(-1)
    p[: len(ids)] = np.fromiter((propensity(i) for i in range(len(ids))), float, len(ids))
    sums = blocks.sum(axis=1)

    def drawn(weights: np.ndarray, at: float) -> int:
        i = min(int(weights.cumsum().searchsorted(at, side="right")), len(weights) - 1)
        while weights[i] <= 0:  # rounding at a step's edge
            i -= 1
        return i

    time = 0.0
    for step in range(steps):
        total = sums.sum()
        if total <= 0:
            return
        time += rng.exponential(1 / total)
        at = rng.random() * total
        b = drawn(sums, at)
        i = b * width + drawn(blocks[b], at - sums[:b].sum())
        changed = set()
        for k, s in enumerate(places[i].tolist()):
            if s >= 0:
                count[s] = count.get(s, 0) + (1 if k > 1 else -1)
                changed.add(s)
        touched = {j for s in changed for j in users(s)}
        for j in touched:
            p[j] = propensity(j)
        for k in {j // width for j in touched}:
            sums[k] = blocks[k].sum()
        yield step, ids.item(i), time


def simulated(network: DataFrame, initial: DataFrame, n: int, steps: int, base_seed: int = 1000, factors: Factors | None = None) -> DataFrame:
    """seed, step, reaction_id, time of n simulations.

    The network goes to every task: a run simulates it whole, so it fits one.
    """
    spark = network.sparkSession
    ship(spark)
    net = network.select("reaction_id", *KEYS, "rate").orderBy("reaction_id").toPandas()
    start = {r.species_id: r["count"] for r in initial.filter("count > 0").toLocalIterator()}
    held = spark.sparkContext.broadcast((net.reaction_id.to_numpy(), net[KEYS].to_numpy(), net.rate.to_numpy(), start))
    f = factors or Factors()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, places, rates, begin = held.value
        for b in batches:
            for seed in b.seed:
                rows: list[tuple[int, int, float]] = []
                for row in trajectory(int(seed), ids, places, rates, begin, steps, f):
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield pd.DataFrame(rows, columns=["step", "reaction_id", "time"]).assign(seed=seed)[["seed", "step", "reaction_id", "time"]]
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["step", "reaction_id", "time"]).assign(seed=seed)[["seed", "step", "reaction_id", "time"]]

    seeds = spark.range(n, numPartitions=max(1, min(n, 8 * spark.sparkContext.defaultParallelism))).select((F.col("id") + base_seed).cast("int").alias("seed"))
    return seeds.mapInPandas(run, "seed int, step int, reaction_id long, time double")
