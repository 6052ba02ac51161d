"""Dense numbers and running totals in a total order, without one task that sees all rows.

Rows are dealt into ranges of the order and written once with their place: a
range partitioning that is planned twice may choose other ranges each time, as it
samples and merges partitions anew, so counts and rows come from the one table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxloom import shared

#: The place of a row: its range above bit 33, its number in the range below.
AT, RANGE, BEFORE = "place__", "range__", "before__"
_BITS = 33


def placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows as a written table with their place in the order of keys."""
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return shared.written(dealt.select("*", F.monotonically_increasing_id().alias(AT)), "ranges")


def _with_before(table: DataFrame, size) -> DataFrame:
    """table with its range and the size of all ranges before it."""
    d = table.withColumn(RANGE, F.shiftright(AT, _BITS))
    sizes = d.groupBy(RANGE).agg(size.alias("n"))
    before = sizes.select(RANGE, (F.sum("n").over(Window.orderBy(RANGE)) - F.col("n")).alias(BEFORE))
    return d.join(F.broadcast(before), RANGE)  # one row for each task that wrote the table


def numbered(rows: DataFrame, keys: list[str], name: str, offset: int = 0, kind: str = "long") -> DataFrame:
    """name: offset, offset + 1, ... in order of keys.  Keys should tell rows apart."""
    d = _with_before(placed(rows, keys), F.count("*"))
    own = F.col(AT).bitwiseAND(F.lit((1 << _BITS) - 1))
    return d.select(*(F.col(f"`{c}`") for c in rows.columns), (F.lit(offset) + F.col(BEFORE) + own).cast(kind).alias(name))


def running(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """name: the sum of value over all rows up to this one in order of keys."""
    d = _with_before(placed(rows, keys), F.sum(value))
    own = F.sum(value).over(Window.partitionBy(RANGE).orderBy(AT).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return d.select(*(F.col(f"`{c}`") for c in rows.columns), (F.col(BEFORE) + own).alias(name))
