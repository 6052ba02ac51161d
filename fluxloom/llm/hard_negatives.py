"""Hard negatives by one-dimensional distance keys.

Vectors are augmented by one coordinate, sqrt(M - |x|^2) with M the largest
squared length of all, and an anchor by 0; then |q - x|^2 = |q|^2 + M - 2 q.x, so
the largest inner products are the nearest rows.  Every row belongs to its
nearest pivot and is stored sorted by (pivot, distance to it), in blocks of
BLOCK_ROWS vectors with their lowest and highest distance.

By the triangle inequality a row within r of an anchor has its distance key
within r of the anchor's own distance to that pivot.  So a scan reads the blocks
whose keys lie in these intervals; then the radius grows and the next scan reads
the annuli that are new, until no unread block can hold a row as near as the last
of the best ones found.  Every row is indexed, the result is exact.

Anchors are taken in batches of QUERY_ROWS, sent to the tasks that scan blocks.
A task returns the best few rows of each request that it has seen, so what is
shuffled follows anchors and tasks, not pairs.  The driver sees a batch's vectors
and, for each request, the number found and the last score, nothing else.

Pivots are centres of a bounded sample (SAMPLE_ROWS rows by hash of their ids),
which decide speed alone.

Nulls, empties: rows with a null id, label or vector, or with a null or
non-finite component, take no part.  Vectors of different lengths are filled up
with zeros.  Rows with the same id are rows of their own, an anchor is never its
own positive but its copies may be, and each copy of an anchor gets its rows.
Scores must fit 64 bits.  An empty table, or one without anchors, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxloom.llm import common
from fluxloom.operators import ordering

PIVOTS, SAMPLE_ROWS, BLOCK_ROWS, QUERY_ROWS = 32, 4096, 1024, 16_384
POSITIVES, NEGATIVES, LEAST_PERCENT, SCALE = 5, 5, 80, 256
#: Anchors whose scores with a block are held at once.
SLICE = 512
#: Slack of bounds in units of the longest vector, far above the rounding of distances.
SLACK = 1e-6
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_BLOCK = "pivot int, low double, high double, n int, width int, rows binary, ids binary, labels binary, vectors binary"
_FOUND = "place long, slot int, anchor_id long, positive_id long, positive_score long, score long, vec_id long, row long"


def numeric(rows: DataFrame, anchors: Column, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, v (floor(scale * component)), anchor of the rows that take part."""
    x = F.col(f"`{vector_col}`")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    d = rows.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("int").alias("label"),
        F.transform(x, lambda c: c.cast("double")).alias("v"), anchors.alias("anchor"),
    )
    d = d.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite))
    return d.withColumn("v", F.transform("v", lambda c: F.floor(c * scale)))


@dataclass
class Index:
    """Blocks sorted by (pivot, distance), the rows they were packed from, and what distances need."""

    blocks: DataFrame
    placed: DataFrame
    pivots: np.ndarray
    top: float  # the largest squared length

    def reach(self, q: np.ndarray) -> np.ndarray:
        """Distances of anchors to all pivots."""
        return _distances(np.hstack([q, np.zeros((len(q), 1))]), self.pivots)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))


def _augmented(v: np.ndarray, top: float) -> np.ndarray:
    v = v.astype(np.float64)
    return np.hstack([v, np.sqrt(np.maximum(0.0, top - (v * v).sum(1)))[:, None]])


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)


def centres(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Centres of a sample by Lloyd's rounds from its first rows."""
    c = sample[:n].copy()
    for _ in range(rounds):
        at = _distances(sample, c).argmin(1)
        for i in range(len(c)):
            if (at == i).any():
                c[i] = sample[at == i].mean(0)
    return c


def build(rows: DataFrame, pivots: int = PIVOTS, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS) -> Index | None:
    """The index of numeric() rows as a written table; None of no rows."""
    n, dim, top = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c))).first()
    if not n:
        return None
    dim = max(dim, 1)
    full = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))))
    # A bounded sample, the same at every run.
    some = full.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").toArrow()
    sample = _augmented(_matrix(some.column(0).combine_chunks(), some.num_rows), top)
    points = centres(sample, min(pivots, len(sample)))
    placed = full.withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "label", "anchor", "v")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _distances(_augmented(_matrix(b.column("v"), b.num_rows), top), points)
                at = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(at)), at])], names=[*b.schema.names, "pivot", "distance"])

    placed = common.written(placed.mapInArrow(nearest, "row long, vec_id long, label int, anchor boolean, v array<long>, pivot int, distance double"), "placed")
    # The row breaks ties, so equal vectors lie in as many blocks as they need.
    dealt = placed.drop("anchor").repartitionByRange("pivot", "distance", "row").sortWithinPartitions("pivot", "distance", "row")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(k).to_numpy() for k in ("row", "vec_id", "label", "pivot", "distance")] + [_matrix(b.column("v"), b.num_rows)]
            rest = [np.concatenate(x) for x in zip(rest, now, strict=True)] if rest else now
            start, n = 0, len(rest[0])
            while start < n:
                same = int(np.searchsorted(rest[3], rest[3][start], "right"))
                end = min(same, start + block_rows)
                if end == n and end - start < block_rows:
                    break  # may go on in the next batch
                yield _packed([x[start:end] for x in rest])
                start = end
            rest = [x[start:] for x in rest]
        if rest and len(rest[0]):
            yield _packed(rest)

    return Index(common.written(dealt.mapInArrow(packed, _BLOCK), "blocks"), placed, points, top)


def _packed(part: list[np.ndarray]) -> pa.RecordBatch:
    """One block as a row, its vectors as the narrowest integers that hold them."""
    row, ids, label, pivot, d, v = part
    most = int(np.abs(v).max(initial=0))
    width = next((w for w in (2, 4) if most < 1 << 8 * w - 1), 8)
    cells = [int(pivot[0]), float(d.min()), float(d.max()), len(row), width, row.astype("<i8").tobytes(), ids.astype("<i8").tobytes(), label.astype("<i4").tobytes(), v.astype(f"<i{width}").tobytes()]
    kinds = [pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=[c.split()[0] for c in _BLOCK.split(", ")])


@dataclass
class Batch:
    """Anchors of one batch, and their requests: the best k rows of a score window, of the anchor's label or of others."""

    place: np.ndarray
    row: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    q: np.ndarray
    reach: np.ndarray
    top: float
    of: np.ndarray = None  # each request's anchor, ascending
    slot: np.ndarray = None
    positive: np.ndarray = None
    low: np.ndarray = None
    high: np.ndarray = None
    least: np.ndarray = None  # scores below it can't be among the best any more
    same: bool = True
    k: int = POSITIVES

    @property
    def slack(self) -> float:
        return SLACK * self.top**0.5

    def distance(self, of: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Of anchors and rows with such inner products."""
        return np.sqrt(np.maximum(0.0, (self.q[of] ** 2).sum(1) + self.top - 2.0 * score))


def _scanned(index: Index, b: Batch, inner: np.ndarray, outer: np.ndarray) -> DataFrame:
    """Candidates of the blocks whose bound for an anchor lies in (inner, outer]; anchors with inner >= outer ask for nothing."""
    spark = index.blocks.sparkSession
    near = np.full(len(b.q), np.inf)  # nearer rows are in no window of the anchor
    np.minimum.at(near, b.of, np.where(np.isinf(b.high), 0.0, b.distance(b.of, np.where(np.isinf(b.high), 0.0, b.high))))
    exact = np.float64 if index.top < 2**53 else np.int64
    held = spark.sparkContext.broadcast((b, inner, outer, near, exact))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, inner, outer, near, exact = held.value
        q, first = b.q.astype(exact), np.searchsorted(b.of, np.arange(len(b.q) + 1))
        least, best = b.least.copy(), {}
        for batch in batches:
            for r in batch.to_pylist():
                d = b.reach[:, r["pivot"]]
                bound = np.maximum(0.0, np.maximum(d - r["high"], r["low"] - d) - b.slack)
                asked = np.flatnonzero((bound > inner) & (bound <= outer) & (d + r["high"] + b.slack >= near))
                if not len(asked):
                    continue
                rows, ids, labels = (np.frombuffer(r[k], t) for k, t in (("rows", "<i8"), ("ids", "<i8"), ("labels", "<i4")))
                x = np.frombuffer(r["vectors"], f"<i{r['width']}").reshape(r["n"], -1).astype(exact).T
                for asks in (asked[i : i + SLICE] for i in range(0, len(asked), SLICE)):
                    scores = q[asks] @ x
                    fits = ((labels == b.label[asks][:, None]) == b.same) & (rows != b.row[asks][:, None])
                    line = np.repeat(np.arange(len(asks)), first[asks + 1] - first[asks])
                    want = np.concatenate([np.arange(first[a], first[a + 1]) for a in asks])
                    hit = fits[line] & (scores[line] >= np.maximum(b.low, least)[want][:, None]) & (scores[line] <= b.high[want][:, None])
                    for i in np.flatnonzero(hit.any(1)):
                        at, w = np.flatnonzero(hit[i]), int(want[i])
                        found = np.stack([scores[line[i], at].astype(np.int64), ids[at], rows[at]])
                        if w in best:
                            found = np.concatenate([best[w], found], axis=1)
                        found = best[w] = found[:, np.lexsort((found[2], found[1], -found[0]))[: b.k]]
                        if found.shape[1] == b.k:
                            least[w] = max(least[w], found[0, -1])
        if best:
            w = np.concatenate([np.full(x.shape[1], k) for k, x in best.items()])
            s, ids, rows = np.concatenate(list(best.values()), axis=1)
            of, (pid, ps) = b.of[w], b.positive[:, w]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (b.place[of], b.slot[w], b.vec_id[of], pid, ps, s, ids, rows)], names=[c.split()[0] for c in _FOUND.split(", ")])

    ask = outer > inner
    wide = outer[ask, None] + b.slack
    lows, highs = (b.reach[ask] - wide).min(0), (b.reach[ask] + wide).max(0)
    wanted = F.lit(False)
    for p, (low, high) in enumerate(zip(lows.tolist(), highs.tolist(), strict=True)):
        wanted = wanted | (F.col("pivot") == p) & (F.col("high") >= low) & (F.col("low") <= high)
    return index.blocks.filter(wanted).mapInArrow(scan, _FOUND)


def _last(found: DataFrame, k: int, b: Batch) -> tuple[np.ndarray, np.ndarray]:
    """Rows found and the k-th score of each request of the batch."""
    d = found.filter(F.col("place").between(int(b.place[0]), int(b.place[-1])))
    d = d.withColumn("n", F.row_number().over(Window.partitionBy("place", "slot").orderBy(F.desc("score"), "vec_id", "row"))).filter(F.col("n") <= k)
    t = d.groupBy("place", "slot").agg(F.count("*").alias("n"), F.min("score").alias("last")).toArrow()
    n, last = np.zeros(len(b.of), np.int64), np.zeros(len(b.of), np.int64)
    at = {(p, s): i for i, (p, s) in enumerate(zip(b.place[b.of].tolist(), b.slot.tolist(), strict=True))}
    for p, s, x, y in zip(*(t.column(c).to_pylist() for c in ("place", "slot", "n", "last")), strict=True):
        n[at[p, s]], last[at[p, s]] = x, y
    return n, last


def _searched(index: Index, b: Batch, path: str, first: np.ndarray, farthest: np.ndarray) -> DataFrame | None:
    """Candidates of all requests, in ever wider annuli until their best k are certain, in the table at path.

    first: the radius of each anchor's first scan.  farthest: no row beyond it is wanted; below 0, none at all.
    """
    spark = index.blocks.sparkSession
    inner, outer = np.full(len(b.q), -1.0), np.minimum(first, farthest)
    inner[outer < 0] = np.inf  # nothing is wanted
    found = None
    while (outer > inner).any():
        _scanned(index, b, inner, outer).write.mode("append").parquet(path)
        found = spark.read.schema(_FOUND).parquet(path)
        n, last = _last(found, b.k, b)
        whole = n >= b.k
        b.least = np.where(whole, last, b.least)
        # With k rows found, none beyond the k-th counts; else the radius doubles up to the farthest.
        need = np.where(whole, b.distance(b.of, last) + b.slack, np.inf)
        most = np.full(len(b.q), -1.0)
        np.maximum.at(most, b.of, need)
        wider = np.minimum(np.where(np.isinf(most), 2 * outer + 1, most), farthest)
        done = (inner >= outer) | (wider <= outer)
        inner, outer = np.where(done, np.inf, outer), np.where(done, -1.0, wider)
    return found


def mine(
    rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT, scale: int = SCALE, id_col: str = "vec_id",
    vector_col: str = "embedding", label_col: str = "label", query_rows: int = QUERY_ROWS, pivots: int = PIVOTS, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """For each anchor and each of its best positives: the best rows of other labels whose score is least_percent to 100 percent of the positive's."""
    spark = rows.sparkSession
    common.prepare(spark)
    with common.scratch() as stay:
        index = build(numeric(rows, anchors, scale, id_col, vector_col, label_col), pivots, sample_rows, block_rows)
        if index is None:
            return spark.createDataFrame([], OUT)
        asked = index.placed.filter("anchor").select("row", "vec_id", "label", "v", "pivot", "distance")
        # In order of keys, so that a batch's intervals lie close together.
        asked = common.written(ordering.numbered(asked, ["pivot", "distance", "row"], "place"), "anchors")
        total = asked.count()
        near, far = (common.folder(spark, w) for w in ("positives", "negatives"))
        result = None
        for start in range(0, total, query_rows):
            part = asked.filter(F.col("place").between(start, start + query_rows - 1)).orderBy("place").toArrow()
            b = _batch(index, part)
            _requests(b, np.arange(len(b.q)), positives, True)
            # A positive below 0 has no window.
            farthest = b.distance(np.arange(len(b.q)), np.zeros(len(b.q))) + b.slack
            found = _searched(index, b, near, farthest / 2, farthest)
            best = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), "vec_id", "row"))
            # At most query_rows times positives.
            own = found.filter(F.col("place").between(start, start + query_rows - 1)).withColumn("n", best).filter(F.col("n") <= positives)
            own = own.select("place", F.col("n").cast("int").alias("slot"), "vec_id", "score").filter("score >= 0").orderBy("place", "slot").toArrow()
            if not own.num_rows:
                continue
            place, slot, ids, score = (own.column(c).to_numpy() for c in ("place", "slot", "vec_id", "score"))
            _requests(b, place - start, negatives, False, slot, np.stack([ids, score]), -(-least_percent * score // 100), score)
            farthest, first = np.full(len(b.q), -1.0), np.full(len(b.q), -1.0)
            np.maximum.at(farthest, b.of, b.distance(b.of, b.low) + b.slack)
            np.maximum.at(first, b.of, b.distance(b.of, 0.95 * b.high) + b.slack)
            found = _searched(index, b, far, first, farthest)
            result = result if found is None else found
        if result is not None:
            result.shared_path_ = far
            stay.append(result)
    if result is None:
        return spark.createDataFrame([], OUT)
    rank = F.row_number().over(Window.partitionBy("place", "slot").orderBy(F.desc("score"), "vec_id", "row"))
    ranked = result.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _batch(index: Index, part: pa.Table) -> Batch:
    column = lambda c: part.column(c).to_numpy()
    q = _matrix(part.column("v").combine_chunks(), part.num_rows).astype(np.float64)
    return Batch(column("place"), column("row"), column("vec_id"), column("label"), q, index.reach(q), index.top)


def _requests(b: Batch, of: np.ndarray, k: int, same: bool, slot=None, positive=None, low=None, high=None) -> None:
    n = len(of)
    b.of, b.k, b.same = of, k, same
    b.slot = np.zeros(n, np.int32) if slot is None else slot.astype(np.int32)
    b.positive = np.zeros((2, n), np.int64) if positive is None else positive
    b.low, b.high = (np.full(n, s * np.inf) if x is None else x.astype(np.float64) for s, x in ((-1, low), (1, high)))
    b.least = np.full(n, -np.inf)


def oracle_sql() -> str:
    """The contract by brute force: all anchors against all rows."""
    return f"""WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES}
), n AS (
  SELECT p.*, s.other AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND {LEAST_PERCENT} * positive_score <= 100 * s.score AND s.score <= positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""
