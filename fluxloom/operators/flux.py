"""Flux of species over a firing log, and promotion into the core."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.operators.enumeration import KEYS


def sides(rows: DataFrame, *keep: str) -> DataFrame:
    """reaction_id, kept columns, species_id, produced, consumed: a row for each place of a species in a reaction."""
    place = lambda c, made: F.struct(F.col(c).cast("int").alias("species_id"), F.lit(made).alias("produced"), F.lit(1 - made).alias("consumed"))
    every = F.array(*(place(c, int(c.startswith("product"))) for c in KEYS))
    return rows.select("reaction_id", *keep, F.explode(F.filter(every, lambda s: s["species_id"] >= 0)).alias("s")).select("reaction_id", *keep, "s.*")


def firing_counts(log: DataFrame, seeds: list[int] | None = None) -> DataFrame:
    """reaction_id, firings; firings without a reaction are left out."""
    d = log.filter("reaction_id >= 0")
    if seeds is not None:
        d = d.filter(F.col("seed").isin(list(seeds)))
    return d.groupBy("reaction_id").agg(F.count("*").alias("firings"))


def species_flux(network: DataFrame, log: DataFrame, seeds: list[int] | None = None) -> DataFrame:
    """species_id, produced, consumed, touched, n_rxns.  The log is counted first, so the join is as large as the network."""
    fired = firing_counts(log, seeds).join(network.select("reaction_id", *KEYS), "reaction_id")
    return sides(fired, "firings").groupBy("species_id").agg(
        F.sum(F.col("produced") * F.col("firings")).alias("produced"), F.sum(F.col("consumed") * F.col("firings")).alias("consumed"),
        F.sum("firings").alias("touched"), F.countDistinct("reaction_id").alias("n_rxns"),
    )


def cutoff(flux: DataFrame, metric: str = "produced", fraction: float = 1e-3) -> DataFrame:
    """One row: the share of the metric's total that promotes; 0 without flux."""
    return flux.agg((F.lit(fraction) * F.coalesce(F.sum(metric), F.lit(0))).alias("cutoff"))


def promoted(flux: DataFrame, core: DataFrame, metric: str = "produced", fraction: float = 1e-3) -> DataFrame:
    """species_id and the metric of species at or over the cutoff and not in core, largest first, ties by id."""
    limit = cutoff(flux, metric, fraction).first()["cutoff"]  # one number
    return (
        flux.filter(F.col(metric) >= F.lit(float(limit)))
        .join(core.select(F.col("ind").alias("species_id")).distinct(), "species_id", "left_anti")
        .select("species_id", metric).orderBy(F.desc(metric), "species_id")
    )


def summary(flux: DataFrame) -> DataFrame:
    """Species touched, total produced, and the species with the most, the smallest of equals."""
    best = F.max(F.struct(F.col("produced"), (-F.col("species_id")).alias("minus")))
    return flux.agg(F.count("*").alias("n_touched"), F.coalesce(F.sum("produced"), F.lit(0)).alias("total_produced"), best.alias("b")).select(
        "n_touched", "total_produced", (-F.col("b.minus")).alias("top_species"), F.col("b.produced").alias("top_produced")
    )


def initially_present(initial: DataFrame) -> DataFrame:
    return initial.filter("count > 0").select("species_id")
