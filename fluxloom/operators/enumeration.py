"""Reaction candidates: an equi-join of complexes and products on composition."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxloom import session, shared
from fluxloom.functions import text, thermo
from fluxloom.operators import bucketing, ordering
from fluxloom.schema import NONE

KEYS = ["reactant_1", "reactant_2", "product_1", "product_2"]
CANONICAL = ["k1", "k2", "k3", "k4"]

#: What a side's totals are carried for: candidates() turns them into the change over a reaction.
CARRIED = ["charge", "free_energy", "solvation_free_energy"]

#: Species in a list of a block of numbered candidates, and candidates in a part of a composition.
RANKED, RANKED_PART = 256, 1 << 28


def product_index(species: DataFrame, elements: list[str], wanted: DataFrame | None = None, blocks: int = bucketing.BLOCKS, carried: list[str] | None = None) -> DataFrame:
    """p1 <= p2 (-1: none) with summed element counts, and sums of the carried columns; only compositions that occur in wanted, if given."""
    summed = [*elements, *(carried or [])]
    one = species.select(F.col("ind").alias("p1"), F.lit(NONE).alias("p2"), *summed)
    both = species.select("ind", *summed)
    two = bucketing.pairs(both, both, blocks, unordered=True).select(
        F.least("a_ind", "b_ind").alias("p1"), F.greatest("a_ind", "b_ind").alias("p2"), *((F.col(f"a_{e}") + F.col(f"b_{e}")).alias(e) for e in summed)
    )
    index = one.unionByName(two)
    # Dropped before the shuffle when the wanted compositions are few.
    return index if wanted is None else index.join(wanted.select(*elements).distinct(), elements, "left_semi")


def candidates(complexes: DataFrame, index: DataFrame, keys: list[str], carried: list[str] | None = None, more: list[str] | None = None, parts: int = 0) -> DataFrame:
    """reactant_1, reactant_2, product_1, product_2: equal compositions, without reactions of a side to itself.

    keys: the elements, and the part where both sides are dealt in parts.  Carried
    sums of both tables become r_<column> and p_<column>, so that rules over totals
    decide in the join, before any species is looked up; columns of more, which
    one of the tables has, stay as they are.  With parts, the index is dealt to so
    many of each composition here, and tasks are given by number.
    """
    for c in carried or []:
        complexes, index = complexes.withColumnRenamed(c, f"r_{c}"), index.withColumnRenamed(c, f"p_{c}")
    if parts:
        n, keys = bucketing.tasks_of(index.sparkSession), [*keys, "deal__"]
        index = index.withColumn("deal__", F.pmod(F.hash("p1", "p2"), F.lit(parts))).repartition(n, *keys)
        complexes = complexes.withColumn("deal__", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(n, *keys)
    # A popular composition makes a large key: dealt in parts here or in the tables, or, as a sort-merge join, split by Spark.
    j = complexes.hint("merge").join(index, keys)
    return j.filter(~((F.col("s1") == F.col("p1")) & (F.col("s2") == F.col("p2")))).select(
        F.col("s1").alias("reactant_1"), F.col("s2").alias("reactant_2"), F.col("p1").alias("product_1"), F.col("p2").alias("product_2"),
        *(f"{s}_{c}" for c in carried or [] for s in "rp"), *(more or []),
    )


def unique_ids(species: DataFrame) -> bool:
    """Whether each id is there once, none null or below 0; then candidates and complexes come once each."""
    n, ids, least = species.agg(F.count("*"), F.countDistinct("ind"), F.min("ind")).first()
    return n == ids and (least is None or least >= 0)


def candidate_totals(species: DataFrame, core: DataFrame, elements: list[str]) -> DataFrame:
    """n, and the checksum: the sum of all ids of candidates() around a core, by counting; species have unique_ids().

    Ids count by composition: of pairs of species of two compositions there are as
    many as the product of their numbers, and each species is in as many as the
    other has members.  Sides of one composition multiply likewise, and every
    complex is once a product of itself.
    """
    big = lambda c: F.col(c).cast("decimal(38,0)")
    fresh = core.select("ind").distinct().withColumn("core", F.lit(True))
    d = species.join(fresh, "ind", "left").withColumn("core", F.coalesce("core", F.lit(False)))
    # Compositions are few next to species: each has a row for its members in the core and one for the others.
    d = shared.written(d.groupBy(*elements, "core").agg(F.count("*").alias("n"), F.sum(F.col("ind").cast("long")).alias("ids")), "compositions")
    d = d.na.drop(subset=elements).select(F.struct(*elements, "core").alias("ind"), big("n").alias("n"), big("ids").alias("ids"))
    one = F.col("a_ind") == F.col("b_ind")
    pairs = bucketing.pairs(d, d, unordered=True).select(
        *((F.col(f"a_ind.{e}") + F.col(f"b_ind.{e}")).alias(e) for e in elements), F.expr("a_ind.core OR b_ind.core").alias("core"),
        F.when(one, F.expr("a_n * (a_n + 1) / 2").cast("decimal(38,0)")).otherwise(F.expr("a_n * b_n").cast("decimal(38,0)")).alias("n"),
        F.when(one, F.expr("a_ids * (a_n + 1)")).otherwise(F.expr("a_ids * b_n + b_ids * a_n")).cast("decimal(38,0)").alias("ids"),
    )
    single = d.select(*(f"ind.{e}" for e in elements), "ind.core", "n", (F.col("ids") + NONE * F.col("n")).cast("decimal(38,0)").alias("ids"))
    sides = pairs.unionByName(single).groupBy(*elements).agg(
        *(F.sum(F.when(test, F.col(c)).otherwise(F.lit(0).cast("decimal(38,0)"))).cast("decimal(38,0)").alias(f"{c}_{side}") for c in ("n", "ids") for side, test in (("p", F.lit(True)), ("r", F.col("core"))))
    )
    n = F.sum(F.expr("CAST(n_r * n_p - n_r AS DECIMAL(38,0))"))
    total = F.sum(F.expr("CAST(ids_r * n_p + ids_p * n_r - 2 * ids_r AS DECIMAL(38,0))"))
    return sides.agg(F.coalesce(n, F.lit(0)).cast("long").alias("n"), F.when(n > 0, wrapped(total)).alias("checksum"))


def wrapped(total: Column) -> Column:
    """A decimal as a long, modulo 2^64 beyond what a long holds."""
    round_, half = (F.expr(f"CAST('{1 << k}' AS DECIMAL(20,0))") for k in (64, 63))
    low = F.pmod(total.cast("decimal(38,0)"), round_)
    return F.when(low >= half, low - round_).otherwise(low).cast("long")


def touching(rows: DataFrame, core: DataFrame, a: str = "reactant_1", b: str = "reactant_2") -> DataFrame:
    """Rows with either id in core."""
    c = core.select(F.col("ind").alias("core_id")).distinct().withColumn("yes", F.lit(True))
    one, two = c.toDF("core_1", "yes_1"), c.toDF("core_2", "yes_2")
    joined = rows.join(one, F.col(a) == F.col("core_1"), "left").join(two, F.col(b) == F.col("core_2"), "left")
    return joined.filter("yes_1 OR yes_2").select(*rows.columns)


def attached(rows: DataFrame, species: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The four species of each row as structs r1, r2, p1, p2 of the given columns; null where there is none.

    A join by id for each: Spark broadcasts the species table if these columns
    are small, and shuffles rows otherwise.
    """
    out = rows
    for side, key in zip(("r1", "r2", "p1", "p2"), KEYS, strict=True):
        s = species.select(F.struct(*(species.columns if columns is None else columns)).alias(side), F.col("ind").alias("id__"))
        out = out.join(s, F.col(key) == F.col("id__"), "inner" if side in ("r1", "p1") else "left").drop("id__")
    return out


def attached_candidates(complexes: DataFrame, index: DataFrame, keys: list[str], species: DataFrame, of: Callable[[Column, Column], tuple[Column, Column]], parts: int = 0) -> DataFrame:
    """attached() candidates, whose species are looked up once for each side and not for each candidate.

    of(one, two) gives what a side of these species, as structs (null where there
    is no second), carries into the join as its two structs.
    """
    def side(d: DataFrame, one: str, two: str, s: str) -> DataFrame:
        names = d.columns
        for key, name, how in ((one, "one__", "inner"), (two, "two__", "left")):
            d = d.join(species.select(F.struct(*species.columns).alias(name), F.col("ind").alias("id__")), F.col(key) == F.col("id__"), how).drop("id__")
        first, second = of(F.col("one__"), F.col("two__"))
        return d.select(*names, first.alias(f"{s}1__"), second.alias(f"{s}2__"))

    sides = ["r1", "r2", "p1", "p2"]
    rows = candidates(side(complexes, "s1", "s2", "r"), side(index, "p1", "p2", "p"), keys, more=[f"{s}__" for s in sides], parts=parts)
    return rows.select(*KEYS, *(F.col(f"{s}__").alias(s) for s in sides))


def canonical(df: DataFrame) -> list[Column]:
    """Unordered sides, direction kept."""
    return [
        F.least("reactant_1", "reactant_2").alias("k1"), F.greatest("reactant_1", "reactant_2").alias("k2"),
        F.least("product_1", "product_2").alias("k3"), F.greatest("product_1", "product_2").alias("k4"),
    ]


def fresh(batch: DataFrame, network: DataFrame | None = None, stored: list[DataFrame] | None = None, buckets: int = 0) -> DataFrame:
    """One row of each reaction, the least by columns, and none that the network has.

    stored: the canonical keys of the network's rounds, bucketed by them.  The
    batch is then dealt to as many buckets and the network's keys are read where
    they lie, so what is shuffled follows the batch.
    """
    names = batch.columns
    keyed = batch.select(F.struct(*names).alias("row"), *canonical(batch))
    if stored:
        keyed = keyed.repartition(buckets, *CANONICAL)
    one = keyed.groupBy(*CANONICAL).agg(F.min("row").alias("row"))
    if network is not None:
        one = one.join(network.select(*canonical(network)).distinct(), CANONICAL, "left_anti")
    for keys in stored or []:
        one = one.join(keys.hint("merge"), CANONICAL, "left_anti")
    return one.select("row.*")


def fresh_candidates(complexes: DataFrame, index: DataFrame, keys: list[str], network: DataFrame | None = None, parts: int = 0, **more) -> DataFrame:
    """fresh(candidates()) of species with unique_ids(), whose candidates come once each: none is moved but those that may be in the network.

    network: its canonical keys, or a list of tables of them as more's stored.
    Only candidates whose both sides are sides of the network's reactions are held
    against it; the rest are new.
    """
    known = reduce(DataFrame.unionByName, [d.select(*CANONICAL) for d in ([network] if network is not None else more["stored"])])

    def marked(rows: DataFrame, one: str, two: str, k: list[str], name: str) -> DataFrame:
        sides = known.select(*(F.col(c).alias(f"{c}__") for c in k)).distinct().withColumn(name, F.lit(True))
        on = (F.least(one, two) == F.col(f"{k[0]}__")) & (F.greatest(one, two) == F.col(f"{k[1]}__"))
        return rows.join(sides, on, "left").select(*rows.columns, F.coalesce(name, F.lit(False)).alias(name))

    complexes, index = marked(complexes, "s1", "s2", CANONICAL[:2], "known_r"), marked(index, "p1", "p2", CANONICAL[2:], "known_p")
    rest = candidates(complexes, index, keys, more=["known_r", "known_p"], parts=parts).filter("NOT (known_r AND known_p)").select(*KEYS)
    both = candidates(complexes.filter("known_r"), index.filter("known_p"), keys, parts=parts)
    as_network = None if network is None else network.toDF(*KEYS)
    return rest.unionByName(fresh(both, as_network, **more))


def duplicate_groups(network: DataFrame) -> DataFrame:
    """k1..k4, n of the reactions that occur more than once; none in a sound network."""
    return network.select(*canonical(network)).groupBy("k1", "k2", "k3", "k4").agg(F.count("*").alias("n")).filter("n > 1")


def numbered(rows: DataFrame, offset: int = 0) -> DataFrame:
    """reaction_id from offset on without gaps, in order of the reactions' ids."""
    return ordering.numbered(rows, KEYS, "reaction_id", offset)


def numbered_candidates(species: DataFrame, core: DataFrame, keys: list[str], offset: int = 0, parts: int = 0) -> DataFrame:
    """numbered(candidates()) around a core, by counting: no product and no candidate is sorted, written or moved; species have unique_ids().

    A complex's candidates follow those of all complexes before it, which are as
    many as their compositions have products but themselves, and stand in order of
    the products' places in the composition.  A product's first species makes up
    its composition with species of one other composition alone, so its place is
    a number of the first species plus the second's place among those.
    """
    session.ship(species.sparkSession)
    n, ids = bucketing.tasks_of(species.sparkSession), species.schema["ind"].dataType.simpleString()
    fresh = core.select("ind").distinct().withColumn("core", F.lit(True))
    d = species.na.drop(subset=keys).select("ind", *keys).join(fresh, "ind", "left").withColumn("core", F.coalesce("core", F.lit(False)))
    d = d.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ind", "core"))).alias("m")).select(F.struct(*keys).alias("ind"), F.col("m.ind").alias("ids"), F.col("m.core").alias("core"))
    two = bucketing.pairs(d, d).select(*((F.col(f"a_ind.{k}") + F.col(f"b_ind.{k}")).alias(k) for k in keys), *(f"{x}_{c}" for x in "ab" for c in ("ids", "core")))
    one = d.select(*(f"ind.{k}" for k in keys), F.col("ids").alias("a_ids"), F.col("core").alias("a_core"), F.lit(None).alias("b_ids"), F.lit(None).alias("b_core"))
    schema = ", ".join([*(f"{k} {species.schema[k].dataType.simpleString()}" for k in keys), f"size long, many long, p1 array<{ids}>, base array<long>, p2 array<{ids}>, place array<long>, s1 array<{ids}>, s2 array<{ids}>, own array<long>"])
    held = shared.written(one.unionByName(two).repartition(n, *keys).groupBy(*keys).applyInPandas(lambda rows: _ranked(rows, keys, RANKED), schema), "ranked")
    found = held.filter("s1 IS NOT NULL").select(*keys, "size", F.explode(F.arrays_zip("s1", "s2", "own")).alias("x")).select("x.s1", "x.s2", *keys, "x.own", (F.col("size") - 1).alias("n"))
    found = ordering.running(found, ["s1", "s2"], "n", "until").withColumn("start", F.col("until") - F.col("n") + F.lit(offset))
    # A row for each composition: in how many parts its blocks of products are dealt.
    dealt = held.filter("s1 IS NOT NULL").groupBy(*keys).agg(F.ceil(F.sum(F.size("s1")) * F.max("size") / F.lit(RANKED_PART)).cast("int").alias("parts"))
    number, at = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("many").desc(), "p1", "p2")), [*keys, "part"]
    left = held.filter("p1 IS NOT NULL").join(dealt, keys).withColumn("part", F.pmod(number, F.col("parts"))).select(*at, "p1", "base", "p2", "place").repartition(n, *at)
    left = left.select(*at, "p2", "place", F.explode(F.arrays_zip("p1", "base")).alias("x")).select(*at, "x", F.explode(F.arrays_zip("p2", "place")).alias("y"))
    left = left.filter("y.p2 = -1 OR x.p1 <= y.p2").select(*at, F.col("x.p1").alias("product_1"), F.col("y.p2").alias("product_2"), (F.col("x.base") + F.col("y.place")).alias("rank"))
    block = F.pmod(F.hash("s1"), F.lit(max(parts, 1))).alias("block")
    right = found.groupBy(*keys, block).agg(F.collect_list(F.struct("s1", "s2", "start", "own")).alias("rows")).join(dealt, keys)
    right = right.select(*keys, "rows", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).repartition(n, *at)
    # A product's complexes are made from their blocks one after the other; the join sorts products, few next to candidates.
    rows = left.hint("merge").join(right, at).select("product_1", "product_2", "rank", F.explode("rows").alias("r")).filter("rank <> r.own")
    return rows.select(
        F.col("r.s1").alias("reactant_1"), F.col("r.s2").alias("reactant_2"), "product_1", "product_2",
        (F.col("r.start") + F.col("rank") - (F.col("rank") > F.col("r.own")).cast("int")).alias("reaction_id"),
    )


def _ranked(rows: pd.DataFrame, keys: list[str], edge: int) -> pd.DataFrame:
    """The products of one composition in blocks, with what their places add up from, and its complexes with theirs; rows: members of a composition, and of the one that makes up the rest (None: none)."""
    groups = [tuple(None if x is None else np.asarray(x) for x in r) for r in zip(rows["a_ids"], rows["a_core"], rows["b_ids"], rows["b_core"], strict=True)]
    below = [np.zeros(len(a), dtype=np.int64) if b is None else np.searchsorted(b, a) for a, _, b, _ in groups]
    count = [np.ones(len(a), dtype=np.int64) if b is None else len(b) - low for (a, _, b, _), low in zip(groups, below, strict=True)]
    first, many = np.concatenate([g[0] for g in groups]), np.concatenate(count)
    order = np.lexsort((np.repeat([g[2] is not None for g in groups], [len(g[0]) for g in groups]), first))
    before = np.zeros(len(first), dtype=np.int64)
    before[order] = np.cumsum(many[order]) - many[order]
    own, size, out = rows.iloc[0][keys].to_dict(), int(many.sum()), []
    for (a, a_core, b, b_core), low, base in zip(groups, below, np.split(before, np.cumsum([len(g[0]) for g in groups])[:-1]), strict=True):
        base, second = base - low, np.array([NONE]) if b is None else b
        for i in range(0, len(a), edge):
            x = slice(i, i + edge)
            for j in range(0, len(second), edge):
                y = slice(j, j + edge)
                fits = np.ones((len(a[x]), 1), dtype=bool) if b is None else a[x][:, None] <= b[y][None, :]
                if not fits.any():
                    continue
                place = np.arange(len(second))[y]
                out.append(own | {"size": size, "many": int(fits.sum()), "p1": a[x], "base": base[x], "p2": second[y], "place": place, "s1": None, "s2": None, "own": None})
                k, m = np.nonzero(fits & (a_core[x][:, None] | (False if b is None else b_core[y][None, :])))
                if len(k):
                    out.append(own | {"size": size, "many": 0, "p1": None, "base": None, "p2": None, "place": None, "s1": a[x][k], "s2": second[y][m], "own": base[x][k] + place[m]})
    return pd.DataFrame(out, columns=[*keys, "size", "many", "p1", "base", "p2", "place", "s1", "s2", "own"])


def finished(kept: DataFrame, temperature: float) -> DataFrame:
    """Rows of the network from candidates with dG and dq: counts, barrier and rate by default."""
    n = lambda c: (1 + (F.col(c) != NONE).cast("int")).cast("int")
    barrier = F.coalesce(F.col("dG_barrier"), F.lit(0.0))
    return kept.select(
        *KEYS, n("reactant_2").alias("number_of_reactants"), n("product_2").alias("number_of_products"),
        F.coalesce(F.col("rate"), thermo.eyring_rate(barrier, temperature)).alias("rate"), "dG", barrier.alias("dG_barrier"),
        (F.col("dq") != 0).cast("int").alias("is_redox"),
    )


def by_arity(network: DataFrame) -> DataFrame:
    key = text.arity(F.col("number_of_reactants"), F.col("number_of_products"))
    return network.groupBy(key.alias("arity")).agg(F.count("*").alias("n"))


def species_in(network: DataFrame) -> DataFrame:
    """ind of every species that occurs: a union of four columns, distinct."""
    return network.select(F.explode(F.array(*KEYS)).alias("ind")).filter(F.col("ind") >= 0).distinct()
