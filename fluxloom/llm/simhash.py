"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position gets a nonzero vector of RADIUS + 1 bits.  For each nonzero
vector v, a mask holds the positions whose vector has an odd number of bits in
common with v.  The vectors of up to RADIUS differing positions span too little
to meet every v, so some mask holds none of these positions: any two
fingerprints within the radius agree under one of the 2^(RADIUS+1) - 1 masks.

Equal fingerprints are one class from the start.  Classes meet in buckets (mask,
masked value); a task compares a bucket's members by vector operations and
returns a spanning forest of its links, not its pairs.  Buckets above
BUCKET_MEMBERS take another exact way, whose work grows with their members
alone: each member is a centre of the values within distance 1 and a neighbour
of those within 2; at a value with a centre all neighbours link to its smallest
centre, which is within 1 + 2 of them, and every pair within 3 meets so.

Nulls, empties: texts without words, null ones too, have fingerprint zero, linked
like any other.  A null id never is a component's id; a component of such rows
alone has none.  Repeated rows are linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxloom.llm import common, graph

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
BUCKET_MEMBERS = 2048
HOT_SHARE = 2000
#: Blocks of 4,096 positions whose kept rows are applied at once: some 40 MB where files have long paths.
GROUP_BLOCKS = 1 << 16


def fingerprint(text: str) -> int:
    """Unsigned; bit i is set if over half of the shingles' hashes have it."""
    import xxhash

    words = text.encode().lower().split()  # bytes: A-Z alone, ASCII white space alone
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), "<u8")
    ones = sum(np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for i in range(0, len(h), 65_536))
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(text: Column) -> Column:
    """A column of fingerprints as signed longs."""

    @F.pandas_udf("long")
    def of(s: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in s], np.uint64).view(np.int64))

    return of(F.coalesce(text, F.lit("")))


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks, as signed longs."""
    n = (1 << (radius + 1)) - 1
    found = [sum(1 << i for i in range(BITS) if ((1 + i % n) & v).bit_count() & 1) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join a bucket's members as all their pairs within the radius would."""
    if len(fps) == 2:
        return [(int(fps[0]), int(fps[1]))] if int(fps[0] ^ fps[1]).bit_count() <= radius else []
    links, todo = [], fps
    while len(todo):
        front, todo = todo[:1], todo[1:]
        while len(front) and len(todo):  # everything reached is taken out
            near = np.bitwise_count(todo ^ front[0]) <= radius
            links += [(int(front[0]), int(y)) for y in todo[near]]
            front, todo = np.concatenate([front[1:], todo[near]]), todo[~near]
    return links


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(classes: DataFrame, radius: int = RADIUS, bucket_members: int = BUCKET_MEMBERS) -> DataFrame:
    """fp (distinct) -> a, b: links whose components are those of all pairs within the radius."""
    common.prepare(classes.sparkSession)
    entry = F.explode(F.array(*(F.struct(F.lit(i).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k")) for i, m in enumerate(masks(radius)))))
    entries = classes.select("fp", entry.alias("e")).select("e.t", "e.k", "fp")
    sizes = entries.groupBy("t", "k").agg(F.count("*").alias("n"))
    hot = common.written(sizes.filter(F.col("n") > bucket_members).select("t", "k"), "buckets")
    usual = entries.join(hot, ["t", "k"], "left_anti").repartition("t", "k").sortWithinPartitions("t", "k")

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple | None = None
        pairs: list[tuple[int, int]] = []
        for b in batches:
            t, k, fp = (b.column(i).to_numpy() for i in range(3))
            fp = fp.view(np.uint64)
            if rest is not None:
                t, k, fp = (np.concatenate(x) for x in zip(rest, (t, k, fp), strict=True))
            cut = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            starts = np.concatenate([[0], cut]).astype(np.int64)
            ends = np.concatenate([cut, [len(fp)]]).astype(np.int64)
            for i in np.flatnonzero(ends[:-1] - starts[:-1] > 1):
                pairs += _forest(fp[starts[i] : ends[i]], radius)
            rest = (t[starts[-1] :], k[starts[-1] :], fp[starts[-1] :])  # may go on in the next batch
            if len(pairs) > 50_000:
                yield _pairs(pairs)
                pairs = []
        if rest is not None and len(rest[2]) > 1:
            pairs += _forest(rest[2], radius)
        if pairs:
            yield _pairs(pairs)

    found = usual.mapInArrow(bucket, "a long, b long")
    crowded = entries.join(hot, ["t", "k"], "left_semi").select("fp").distinct()
    return found.unionByName(star_links(crowded, radius))


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(pairs, np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])


def star_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp (distinct) -> a, b by meeting values: some thousand rows for each fingerprint, however many are near."""
    inner = radius // 2
    flips = [sum(1 << i for i in c) for d in range(radius - inner + 1) for c in combinations(range(BITS), d)]
    centre = [f.bit_count() <= inner for f in flips]

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flip = np.array(flips, np.uint64)
        for b in batches:
            for x in b.column(0).to_numpy().view(np.uint64):
                n = len(flip)
                yield pa.RecordBatch.from_arrays([pa.array((flip ^ x).view(np.int64)), pa.array(np.full(n, x).view(np.int64)), pa.array(centre)], names=["v", "fp", "centre"])

    rows = fps.mapInArrow(values, "v long, fp long, centre boolean")
    centres = rows.filter("centre").groupBy("v").agg(F.min("fp").alias("c"))
    return rows.join(centres, "v").filter("fp != c").select(F.col("fp").alias("a"), F.col("c").alias("b")).distinct()


def labelled(
    docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", bucket_members: int = BUCKET_MEMBERS, carried: tuple[Column, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """doc_id, fp and the carried columns of each row; and fp, component_id, root (the component's first fingerprint) of each class."""
    common.prepare(docs.sparkSession)
    with common.scratch() as stay:
        rows = common.written(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprints(F.col(text_col)).alias("fp"), *carried), "fingerprints")
        classes = common.written(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "classes")
        nodes = common.written(graph.components(links(classes.select("fp"), radius, bucket_members)), "components")
        linked = nodes.join(classes, F.col("node") == F.col("fp")).select("node", "root", "first")
        named = linked.groupBy("root").agg(F.min("first").alias("component_id"))
        label = nodes.join(named, "root").select(F.col("node").alias("fp"), "root", "component_id")
        labels = classes.join(label, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"), F.coalesce("root", "fp").alias("root"), "copies")
        labels = common.written(labels, "labels")
        stay += [rows, labels]
    return rows, labels


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with component_id and root by fingerprint.

    Classes with over a HOT_SHARE-th of all rows are fewer than HOT_SHARE,
    whatever the data: they are broadcast, so no copies meet in one task.
    """
    total = labels.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = F.col("copies") * HOT_SHARE > F.lit(total)
    many, few = labels.filter(hot).drop("copies"), labels.filter(~hot).drop("copies")
    large = rows.join(F.broadcast(many), "fp")
    return large.unionByName(rows.join(F.broadcast(many.select("fp")), "fp", "left_anti").join(few, "fp"))


def components(docs: DataFrame, **more) -> DataFrame:
    """doc_id, fingerprint, component_id of each row."""
    rows, labels = labelled(docs, **more)
    return with_labels(rows, labels).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _kept_blocks(kept: DataFrame) -> DataFrame:
    """path, at of rows -> path, block, words: a bit for each of a block's 4,096 positions, set where a row is kept."""
    words = kept.groupBy("path", F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits"))
    held = words.groupBy("path", F.shiftright("w", 6).alias("block")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("w").bitwiseAND(F.lit(63)), "bits"))).alias("m"))
    return held.select("path", "block", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0).cast("long"))).alias("words"))


def at_positions(table: DataFrame, kept: DataFrame, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """The rows of a table in Parquet files that lie at the kept positions (path, at; none twice).

    A row is decided where its file is read, by the bits of its block: no row of
    the table is moved.  The bits are broadcast.  Beyond group_blocks blocks they go
    out group by group, each with its own files alone, and each group's rows are
    written before the next one begins, so what is broadcast and what the driver
    holds is bounded whatever the table's size.
    """
    spark = table.sparkSession
    blocks = common.written(_kept_blocks(kept), "blocks")
    groups = max(1, -(-blocks.count() // group_blocks))
    place = table.metadataColumn("_metadata")
    rows = table.select(F.struct(*(F.col(f"`{n}`") for n in table.columns)).alias("row"), place.getField("file_path").alias("path"), place.getField("row_index").alias("at"))
    group = F.pmod(F.xxhash64("path"), F.lit(groups))

    def of(g: int) -> DataFrame:
        some, own = (rows, blocks) if groups == 1 else (rows.filter(group == g), blocks.filter(group == g))
        found = some.withColumn("block", F.shiftright("at", 12)).join(F.broadcast(own), ["path", "block"])
        return found.filter("shiftright(words[CAST(shiftright(at, 6) & 63 AS INT)], CAST(at & 63 AS INT)) & 1 = 1").select("row.*")

    if groups == 1:
        return of(0)
    path = common.folder(spark, "positions")
    for g in range(groups):
        of(g).write.mode("append").parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_blocks: int = GROUP_BLOCKS, **more) -> DataFrame:
    """docs with one row of each component: the smallest id's; of rows that share it, the first by text hash, then by the other columns'.

    What is decided about a row goes by its place (file and position), so texts
    stay where they lie however many are dropped.  docs that aren't a table of
    Parquet files as it stands are written first.
    """
    table = docs if common.with_places(docs) else common.written(docs, "texts")
    place = table.metadataColumn("_metadata")
    others = F.struct(*(F.col(f"`{n}`") for n in table.columns if n != text_col))
    carried = (F.xxhash64(f"`{text_col}`").alias("h"), F.xxhash64(F.to_json(others)).alias("more"), place.getField("file_path").alias("path"), place.getField("row_index").alias("at"))
    rows, labels = labelled(table, id_col=id_col, text_col=text_col, carried=carried, **more)
    first = with_labels(rows, labels).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("h", "more", "path", "at")).alias("row"))
    return at_positions(table, first.select("row.path", "row.at"), group_blocks)
