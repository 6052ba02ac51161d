"""Analytics of a finished network and its firing log."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxloom import shared
from fluxloom.functions import thermo
from fluxloom.operators import ordering
from fluxloom.operators.flux import sides


def firings(network: DataFrame, log: DataFrame) -> DataFrame:
    """seed, step, reaction_id, species_id, produced, consumed: the log with the sides of each reaction."""
    return log.filter("reaction_id >= 0").select("seed", "step", "reaction_id").join(sides(network), "reaction_id")


def counted(network: DataFrame, log: DataFrame) -> DataFrame:
    """species_id, reaction_id, produced, consumed by firings; the log is counted before the join."""
    n = log.filter("reaction_id >= 0").groupBy("reaction_id").agg(F.count("*").alias("firings"))
    return sides(network).join(n, "reaction_id").groupBy("species_id", "reaction_id").agg(
        F.sum(F.col("produced") * F.col("firings")).alias("produced"), F.sum(F.col("consumed") * F.col("firings")).alias("consumed")
    )


def final_state(network: DataFrame, log: DataFrame, initial: DataFrame) -> DataFrame:
    """species_id, expected: the initial count plus the mean net change over the seeds that fired."""
    seeds = log.agg(F.countDistinct("seed")).first()[0]  # one number
    net = counted(network, log).groupBy("species_id").agg(F.sum(F.col("produced") - F.col("consumed")).alias("net"))
    start = initial.select("species_id", "count")
    return start.join(net, "species_id", "full").select(
        "species_id", (F.coalesce("count", F.lit(0)) + F.coalesce("net", F.lit(0)) / F.lit(max(1, seeds))).alias("expected")
    )


def sinks(network: DataFrame, log: DataFrame, initial: DataFrame) -> DataFrame:
    """Totals and distinct reactions each way, ratio (1e10 where nothing is consumed) and expected value."""
    t = counted(network, log).groupBy("species_id").agg(
        F.sum("produced").alias("n_produced"), F.sum("consumed").alias("n_consumed"),
        F.count_if(F.col("produced") > 0).alias("n_producing"), F.count_if(F.col("consumed") > 0).alias("n_consuming"),
    )
    ratio = F.when(F.col("n_consumed") == 0, F.lit(1e10)).otherwise(F.col("n_produced") / F.when(F.col("n_consumed") != 0, F.col("n_consumed")))
    return t.withColumn("ratio", ratio).join(final_state(network, log, initial), "species_id", "left")


def sink_filter(found: DataFrame, species: DataFrame | None = None, min_ratio: float = 1.0, min_expected: float = 0.1) -> DataFrame:
    """Species that are made more than used and remain; of spin 1 where species are given."""
    d = found.filter((F.col("n_produced") + F.col("n_consumed") > 0) & (F.col("ratio") > min_ratio) & (F.col("expected") > min_expected))
    return d if species is None else d.join(species.filter("spin_multiplicity = 1").select(F.col("ind").alias("species_id")), "species_id", "left_semi")


def sink_report(found: DataFrame, min_expected: float | None = None) -> DataFrame:
    d = found if min_expected is None else found.filter(F.col("expected") >= min_expected)
    return d.orderBy(F.desc("ratio"), "species_id")


def tally(log: DataFrame, above: int = 10) -> DataFrame:
    """Reactions that fired more often than above, most first."""
    return log.filter("reaction_id >= 0").groupBy("reaction_id").agg(F.count("*").alias("firings")).filter(F.col("firings") > above).orderBy(F.desc("firings"), "reaction_id")


def tally_totals(network: DataFrame, log: DataFrame) -> DataFrame:
    """n_reactions, n_firings, n_species that took part: one row joined to one row."""
    fired = log.filter("reaction_id >= 0").groupBy("reaction_id").agg(F.count("*").alias("firings"))
    species = sides(network).join(fired, "reaction_id", "left_semi").agg(F.countDistinct("species_id").alias("n_species"))
    return fired.agg(F.count("*").alias("n_reactions"), F.sum("firings").alias("n_firings")).join(species)


def consumption_report(network: DataFrame, log: DataFrame, species_id: int) -> DataFrame:
    """kind, reaction_id, n of one species: consuming reactions first, then producing, most first."""
    c = counted(network, log).filter(F.col("species_id") == species_id)
    use = c.filter("consumed > 0").select(F.lit("consuming").alias("kind"), "reaction_id", F.col("consumed").alias("n"))
    make = c.filter("produced > 0").select(F.lit("producing").alias("kind"), "reaction_id", F.col("produced").alias("n"))
    return use.unionByName(make).orderBy("kind", F.desc("n"), "reaction_id")


def state_series(network: DataFrame, log: DataFrame, initial: DataFrame) -> DataFrame:
    """seed, step, species_id, count after each step that changes it; a frame by seed and species."""
    net = firings(network, log).groupBy("seed", "species_id", "step").agg(F.sum(F.col("produced") - F.col("consumed")).alias("delta"))
    run = Window.partitionBy("seed", "species_id").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return net.withColumn("run", F.sum("delta").over(run)).join(initial, "species_id", "left").select(
        "seed", "step", "species_id", (F.coalesce("count", F.lit(0)) + F.col("run")).cast("long").alias("count")
    )


def padded_series(series: DataFrame, initial: DataFrame, n_steps: int, seeds: DataFrame) -> DataFrame:
    """series on every step below n_steps: the last count held, the initial one before the first change."""
    # Each row stands until the next one, a pair's first also for the steps before it: no table of all steps is joined or sent to machines.
    order = Window.partitionBy("seed", "species_id").orderBy("step")
    since = F.when(F.lag("step").over(order).isNull(), F.lit(0)).otherwise(F.col("step"))
    until = F.least(F.coalesce(F.lead("step").over(order), F.lit(n_steps)), F.lit(n_steps)) - 1
    d = series.join(seeds, "seed", "left_semi").select("seed", "species_id", F.col("step").alias("at"), "count", since.alias("since"), until.alias("until"))
    d = d.filter("since <= until").join(initial.withColumnRenamed("count", "start"), "species_id", "left")
    d = d.select("seed", "species_id", "at", "count", "start", F.explode(F.sequence("since", "until")).alias("step"))
    held = F.when(F.col("step") >= F.col("at"), F.col("count"))
    return d.select("seed", "step", "species_id", F.coalesce(held, "start", F.lit(0)).cast("long").alias("count"))


def mean_series(network: DataFrame, log: DataFrame, initial: DataFrame, n_steps: int, n_seeds: int) -> DataFrame:
    """species_id, step, mean over n_seeds of the counts of state_series() held on every step below n_steps.

    The mean's changes are added up over seeds first: sums of changes by species
    and step, a running sum, and each value held until the next change.
    """
    d = firings(network, log).groupBy("species_id", "step").agg(F.sum(F.col("produced") - F.col("consumed")).alias("delta"))
    d = d.filter(F.col("step") < n_steps)
    first = d.select("species_id").distinct().select("species_id", F.lit(0).alias("step"), F.lit(0).cast("long").alias("delta"))
    d = d.unionByName(first).groupBy("species_id", "step").agg(F.sum("delta").alias("delta"))
    order = Window.partitionBy("species_id").orderBy("step")
    upto = F.sum("delta").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    until = F.coalesce(F.lead("step").over(order), F.lit(n_steps)) - 1
    d = d.select("species_id", "step", upto.alias("upto"), until.alias("until"))
    d = d.select("species_id", "upto", F.explode(F.sequence("step", "until")).alias("step")).join(initial, "species_id", "left")
    return d.select("species_id", "step", (F.coalesce("count", F.lit(0)) + F.col("upto") / F.lit(n_seeds)).alias("mean"))


def background(mean: DataFrame, of_interest: list[int], above: float = 0.1) -> DataFrame:
    """Species not of interest whose mean passes above at some step."""
    return mean.filter(~F.col("species_id").isin(of_interest) if of_interest else F.lit(True)).groupBy("species_id").agg(F.max("mean").alias("peak")).filter(F.col("peak") > above)


def first_producers(network: DataFrame, log: DataFrame) -> DataFrame:
    """seed, species_id, step, reaction_id of the first firing that makes it."""
    made = firings(network, log).filter("produced > 0")
    return made.groupBy("seed", "species_id").agg(F.min(F.struct("step", "reaction_id")).alias("f")).select("seed", "species_id", "f.*")


def pathways(network: DataFrame, log: DataFrame, initial: DataFrame) -> DataFrame:
    """seed, species_id, pathway: how each seed first made each species.

    A species' pathway is the first firing that makes it, after the pathways of
    those of its reactants that were not there initially.  Where the last
    reaction of a reactant's pathway makes just the reactants, that pathway alone
    precedes.  A producer must fire before its consumer, or it is not followed.

    By pointer doubling: a pathway is a list of pointers to species, followed by
    reactions.  Each round puts the list that a pointed species has by then in
    place of the pointer, so a chain of n reactions takes log2(n) rounds.  A seed's
    species are rows of their own, spread over all tasks.
    """
    from fluxloom.operators.enumeration import KEYS

    with shared.scratch() as stay:
        first = first_producers(network, log).join(network.select("reaction_id", *KEYS), "reaction_id")
        side = lambda *c: F.array_sort(F.filter(F.array(*c), lambda x: x >= 0))
        first = shared.written(first.select("seed", "species_id", "step", "reaction_id", *KEYS[:2], side(*KEYS[:2]).alias("used"), side(*KEYS[2:]).alias("made")), "first")
        absent = initial.filter("count = 0").select(F.col("species_id").alias("x")).distinct()
        made = first.select(F.col("seed").alias("s"), F.col("species_id").alias("x"), F.col("step").alias("before"), F.col("made").alias("head_made")).join(absent, "x", "left_semi")
        # Its heads: producers of an absent reactant that fired before it; place 0 is the second reactant's, whose pathway comes first.
        place = F.explode(F.array(*(F.struct(F.lit(1 - i).alias("place"), F.col(k).alias("x")) for i, k in enumerate(KEYS[:2])))).alias("r")
        asks = first.select("seed", "species_id", "step", "used", place).select("*", "r.place", "r.x").filter("x >= 0")
        heads = asks.join(made.withColumnRenamed("s", "seed"), ["seed", "x"]).filter("before < step")
        head = F.struct("place", "x", (F.col("head_made") == F.col("used")).alias("alone"))
        heads = heads.groupBy("seed", "species_id").agg(F.array_sort(F.collect_list(head)).alias("heads"))
        token = lambda r, p: F.struct(r.cast("long").alias("reaction_id"), p.cast("int").alias("at"))
        own = F.array(token(F.col("reaction_id"), F.lit(None)))
        # The first reactant's head decides first whether it stands alone.
        alone = F.get(F.filter(F.reverse("heads"), lambda h: h["alone"]), F.lit(0))
        taken = F.when(alone.isNotNull(), F.array(alone)).otherwise(F.coalesce("heads", F.array().cast("array<struct<place:int,x:int,alone:boolean>>")))
        rows = first.join(heads, ["seed", "species_id"], "left")
        now = shared.written(rows.select("seed", "species_id", F.concat(F.transform(taken, lambda h: token(F.lit(None), h["x"])), own).alias("way")), "ways")
        done = []
        while True:
            open_ = F.exists("way", lambda t: t["at"].isNotNull())
            done.append(now.filter(~open_))
            left = now.filter(open_)
            if left.isEmpty():
                break
            steps = left.select("seed", "species_id", F.posexplode("way").alias("i", "t")).select("seed", "species_id", "i", F.col("t.at").alias("at"), F.array("t").alias("own"))
            every = done[0]
            for d in [*done[1:], left]:
                every = every.unionByName(d)
            lists = every.join(left.select("seed").distinct(), "seed", "left_semi").select("seed", F.col("species_id").alias("at"), F.col("way").alias("below"))
            full = steps.filter("at IS NOT NULL").join(lists, ["seed", "at"]).select("seed", "species_id", "i", "below")
            full = full.unionByName(steps.filter("at IS NULL").select("seed", "species_id", "i", F.col("own").alias("below")))
            way = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "below"))), lambda x: x["below"]))
            now = shared.written(full.groupBy("seed", "species_id").agg(way.alias("way")), "ways")
        out = done[0]
        for d in done[1:]:
            out = out.unionByName(d)
        out = shared.written(out.select("seed", "species_id", F.transform("way", lambda t: t["reaction_id"]).alias("pathway")), "pathways")
        stay.append(out)
    return out


def pathway_table(paths: DataFrame, network: DataFrame) -> DataFrame:
    """species_id, path_key, pathway, frequency, weight: pathways of equal reaction sets are one, as its lowest seed has it."""
    keyed = paths.withColumn("path_key", F.array_sort(F.array_distinct("pathway")))
    one = keyed.groupBy("species_id", "path_key").agg(F.count("*").alias("frequency"), F.min_by("pathway", "seed").alias("pathway"))
    w = one.select("species_id", "path_key", F.posexplode("pathway").alias("i", "reaction_id")).join(network.select("reaction_id", thermo.cost(F.col("dG")).alias("cost")), "reaction_id")
    # Summed in pathway order, so that the weight doesn't depend on the plan.
    total = w.groupBy("species_id", "path_key").agg(F.sort_array(F.collect_list(F.struct("i", "cost"))).alias("c")).select(
        "species_id", "path_key", F.aggregate("c", F.lit(0.0), lambda a, x: a + x["cost"]).alias("weight")
    )
    return one.join(total, ["species_id", "path_key"]).select("species_id", "path_key", "pathway", "frequency", "weight")


def pathway_report(table: DataFrame, species_id: int, n: int = 100, by_frequency: bool = False) -> DataFrame:
    d = table.filter(F.col("species_id") == species_id)
    order = [F.desc("frequency"), "weight"] if by_frequency else ["weight", F.desc("frequency")]
    return d.orderBy(*order, "path_key").limit(n)


def pathway_reactions(table: DataFrame, k: int) -> DataFrame:
    """species_id, reaction_id: reactions in each species' k lightest pathways."""
    rank = F.row_number().over(Window.partitionBy("species_id").orderBy("weight", "path_key"))
    return table.withColumn("rank", rank).filter(F.col("rank") <= k).select("species_id", F.explode("path_key").alias("reaction_id")).distinct()


def shortest(table: DataFrame, species: DataFrame) -> DataFrame:
    """species_id, length of the shortest pathway as text, 'unreachable' without one."""
    n = table.groupBy("species_id").agg(F.min(F.size("pathway")).alias("n"))
    return species.select("species_id").join(n, "species_id", "left").select("species_id", F.coalesce(F.col("n").cast("string"), F.lit("unreachable")).alias("length"))


def redox_reactions(network: DataFrame) -> DataFrame:
    return network.filter("is_redox = 1")


def redox_report(network: DataFrame, species: DataFrame, electron_free_energy: float) -> DataFrame:
    """One-to-one redox reactions by Marcus barrier."""
    side = lambda name: species.select(F.col("ind").alias(f"{name}_ind"), F.struct("charge", "free_energy", "electron_affinity", "ionization_energy").alias(name))
    d = redox_reactions(network).join(side("r"), F.col("reactant_1") == F.col("r_ind")).join(side("p"), F.col("product_1") == F.col("p_ind"))
    dq = F.col("p.charge") - F.col("r.charge")
    dg = F.col("p.free_energy") - F.col("r.free_energy") + dq * F.lit(electron_free_energy)
    return d.withColumn("marcus_barrier", thermo.marcus_barrier(dg, dq, F.col("r"), F.col("p"))).drop("r", "p", "r_ind", "p_ind").orderBy("marcus_barrier", "reaction_id")


def coordination(network: DataFrame, metals: DataFrame, decoordination: bool = False) -> DataFrame:
    """Two to one with a metal reactant, or one to two with a metal product; dG falling."""
    n, side = ((2, 1), "reactant") if not decoordination else ((1, 2), "product")
    d = network.filter((F.col("number_of_reactants") == n[0]) & (F.col("number_of_products") == n[1]))
    m = metals.select("ind").distinct()
    one = d.join(m, F.col(f"{side}_1") == F.col("ind"), "left_semi")
    two = d.join(m, F.col(f"{side}_2") == F.col("ind"), "left_semi").join(m, F.col(f"{side}_1") == F.col("ind"), "left_anti")
    return one.unionByName(two).orderBy(F.desc("dG"), "reaction_id")


def edges(network: DataFrame, log: DataFrame) -> DataFrame:
    """source, target, firings: every reactant to every product of the reactions that fired."""
    from fluxloom.operators.enumeration import KEYS

    n = log.filter("reaction_id >= 0").groupBy("reaction_id").agg(F.count("*").alias("firings"))
    ends = lambda *c: F.filter(F.array(*c), lambda x: x >= 0)
    d = network.select("reaction_id", *KEYS).join(n, "reaction_id").select(F.explode(ends(*KEYS[:2])).alias("source"), F.array(*KEYS[2:]).alias("t"), "firings")
    return d.select("source", F.explode(F.filter("t", lambda x: x >= 0)).alias("target"), "firings").groupBy("source", "target").agg(F.sum("firings").alias("firings"))


def percentiles(rows: DataFrame, value: str, *groups: str) -> DataFrame:
    """p50, p95, p99 as entries n//2, min(0.95 n, n-1), min(0.99 n, n-1) of the sorted values, without gathering them.

    Distinct values are counted, and a running count over ranges of their order
    gives each one's ranks, so one hot group spreads over tasks as many would.
    """
    d = rows.filter(F.col(value).isNotNull()).select(*groups, value)
    counted_ = d.groupBy(*groups, value).agg(F.count("*").alias("k"))
    ranked = ordering.running(counted_, [*groups, value], "k", "upto")
    of = ranked.groupBy(*(F.col(g).alias(f"{g}_of") for g in groups)).agg(F.sum("k").alias("n"), F.min(F.col("upto") - F.col("k")).alias("before"))
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}_of"))
    ranked = ranked.join(of, same) if groups else ranked.join(F.broadcast(of))  # without groups one row
    upto = F.col("upto") - F.col("before")
    at = {"p50": F.floor(F.col("n") / 2), "p95": F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1), "p99": F.least(F.floor(F.col("n") * 0.99), F.col("n") - 1)}
    return ranked.groupBy(*groups).agg(*(F.min(F.when(upto > i, F.col(value))).alias(k) for k, i in at.items()))


def verdict_stats(cache: DataFrame) -> DataFrame:
    """status, n, allowed, rejected of a verdict cache."""
    return cache.groupBy("status").agg(F.count("*").alias("n"), F.sum("allowed").alias("n_allowed"), F.sum(1 - F.col("allowed")).alias("n_rejected"))


def elapsed_stats(cache: DataFrame) -> DataFrame:
    real = F.when(F.col("elapsed") > 0.01, F.col("elapsed"))
    stamp = F.when(F.col("elapsed") > 0.01, F.col("ts"))
    return cache.agg(F.count("*").alias("n"), F.avg(real).alias("mean_elapsed"), F.max(real).alias("max_elapsed"), F.min(stamp).alias("first_ts"), F.max(stamp).alias("last_ts"))


def rows_of(df: DataFrame) -> Iterator[dict]:
    """Rows of a finished report, one at a time."""
    return (r.asDict(recursive=True) for r in df.toLocalIterator())
