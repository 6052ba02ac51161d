"""Reactant complexes around a core, by semi-naive evaluation.

Pairs come from joins on blocks: each side is cut into blocks of its own, arrays
that have a copy for each block of the other, so the work is an equi-join that
spreads evenly, and nothing is compared with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxloom.operators import ordering
from fluxloom.schema import NONE

BLOCKS, GROUP_SIZE = 32, 1000
#: Ranges of s1 that a composition's rows are numbered in.
CHUNKS = 256


def tasks_of(spark: SparkSession) -> int:
    """Tasks of a join that makes far more rows than it reads; given by number, as Spark would merge them by what they read."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)


def pairs(left: DataFrame, right: DataFrame, blocks: int = BLOCKS, unordered: bool = False) -> DataFrame:
    """Every pair of a row of left and one of right, by their columns ind and others, as a_<column> and b_<column>.

    unordered: both are the same table and each pair comes once, whichever row of
    it is a; a row with itself too.
    """
    n, every = tasks_of(left.sparkSession), F.sequence(F.lit(0), F.lit(blocks - 1))

    def dealt(d: DataFrame, side: str, own: str, other: str, meets: Column) -> DataFrame:
        """A row for each block of d and block of the other that it meets: columns as arrays, which are moved in place of rows."""
        held = d.groupBy(F.pmod(F.hash("ind"), F.lit(blocks)).alias(own)).agg(F.sort_array(F.collect_list(F.struct("ind", *(c for c in d.columns if c != "ind")))).alias("rows__"))
        return held.select(own, F.explode(meets).alias(other), *(F.col(f"rows__.{c}").alias(f"{side}_{c}") for c in d.columns)).repartition(n, "i", "j")

    a = dealt(left, "a", "i", "j", F.sequence(F.col("i"), F.lit(blocks - 1)) if unordered else every)
    b = dealt(right, "b", "j", "i", F.sequence(F.lit(0), F.col("j")) if unordered else every)
    def rows(d: DataFrame, side: str, names: list[str]) -> DataFrame:
        """d with the rows of the side's arrays."""
        mine, at = [f"{side}_{c}" for c in names], f"{side}__"
        d = d.select(*(c for c in d.columns if c != f"{side}_ind"), F.posexplode(f"{side}_ind").alias(at, f"{side}_ind"))
        return d.select(*(F.get(c, F.col(at)).alias(c) if c in mine and c != f"{side}_ind" else c for c in d.columns if c != at))

    # A block's rows fit a task's memory.  The join sorts a's, few next to their pairs, so a task holds one's pairs at once.
    p = rows(rows(a, "a", left.columns).hint("merge").join(b, ["i", "j"]), "b", right.columns)
    p = p.filter("i < j OR a_ind <= b_ind") if unordered else p
    return p.select(*(f"{side}_{c}" for side, d in (("a", left), ("b", right)) for c in d.columns))


def complexes(
    species: DataFrame, core: DataFrame, elements: list[str], new_core: DataFrame | None = None,
    unary: bool = True, pairs_in_core: bool = True, blocks: int = BLOCKS,
) -> DataFrame:
    """s1 <= s2 (or s2 = -1 for single species) and the summed element counts (or whatever columns are named there).

    Without new_core: every pair with a member in core; pairs_in_core=False drops
    those with both.  With it: pairs with a member in new_core and none in the
    rest of core.  Equal pairs come once.
    """
    fresh = core if new_core is None else new_core
    first = species.join(fresh.select("ind").distinct(), "ind", "left_semi")
    partner = species
    if new_core is not None:
        old = core.select("ind").distinct().join(new_core.select("ind").distinct(), "ind", "left_anti")
        partner = species.join(old, "ind", "left_anti")
    marked = first.select("ind").withColumn("fresh", F.lit(True))
    partner = partner.join(marked, "ind", "left").select("ind", *elements, F.coalesce("fresh", F.lit(False)).alias("fresh"))
    p = pairs(first.select("ind", *elements), partner, blocks)
    # A pair of two fresh members meets twice; it is taken from its smaller one.
    p = p.filter("NOT b_fresh OR a_ind <= b_ind")
    if new_core is None and not pairs_in_core:
        p = p.filter("NOT b_fresh")
    total = [(F.col(f"a_{e}") + F.col(f"b_{e}")).alias(e) for e in elements]
    out = p.select(F.least("a_ind", "b_ind").alias("s1"), F.greatest("a_ind", "b_ind").alias("s2"), *total)
    if unary:
        out = out.unionByName(first.select(F.col("ind").alias("s1"), F.lit(NONE).alias("s2"), *elements))
    return out


def grouped(rows: DataFrame, elements: list[str], group_size: int = GROUP_SIZE, chunks: int = CHUNKS) -> DataFrame:
    """composition_id by order of composition, group_id counting each group_size rows of one in order of s1, s2.

    A popular composition is numbered in ranges of s1, each in a task of its own:
    their sizes are counted first and added up.
    """
    low, high = rows.agg(F.min("s1"), F.max("s1")).first()
    if low is None:
        low, high = 0, 0
    width = (high - low) // chunks + 1
    d = rows.withColumn("chunk", F.floor((F.col("s1") - F.lit(low)) / F.lit(width)).cast("int"))
    keys = [*elements, "chunk"]
    sizes = d.groupBy(*keys).agg(F.count("*").alias("n"))
    # At most chunks rows for each composition.
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy(*elements).orderBy("chunk")) - F.col("n"))
    ids = ordering.numbered(rows.select(*elements).distinct(), elements, "composition_id", kind="int")
    at = before.join(ids, elements).select(*keys, "before", "composition_id")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("s1", "s2")) - 1
    group = F.floor((F.col("before") + F.col("number")) / F.lit(group_size)).cast("int").alias("group_id")
    return d.withColumn("number", number).join(at, keys).select(*elements, *(c for c in rows.columns if c not in elements), group, "composition_id")


def group_counts(rows: DataFrame, group_size: int = GROUP_SIZE) -> DataFrame:
    """composition_id, count: the last group's number plus one; full groups are followed by an empty one."""
    return rows.groupBy("composition_id").agg((F.floor(F.count("*") / F.lit(group_size)) + 1).cast("int").alias("count"))


def stats(rows: DataFrame, elements: list[str]) -> DataFrame:
    """Rows, single species, pairs and compositions."""
    return rows.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("s2") == NONE).alias("n_unary"),
        F.count_if(F.col("s2") != NONE).alias("n_pairs"), F.countDistinct(*elements).alias("n_compositions"),
    )
