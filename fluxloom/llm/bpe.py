"""Byte-level BPE encoding and decoding by overlapping chunks.

Texts of at most chunk_chars code points are one chunk.  Longer texts are cut
into chunks that overlap by overlap_chars, in one pass over the text.  Every
chunk is split into pre-tokens by itself, in parallel.  Two splits of the same
text that share one boundary agree from there on, so a chunk takes over from its
predecessor at the first boundary that both found in their overlap.  Where they
share none (a pre-token longer than the overlap), the two are glued and split
again as one text, and the next chunk takes over as before; as its boundaries
were found without knowing where the glued text begins, the place is proved by
the glued split, and where that has no boundary there, more is glued, twice as
many chunks each time.  Then the stretches between the stitches are encoded, each
starting and ending at a true boundary.  Decoding joins the tokens' raw bytes.

Nulls, empties: a null text is an empty text, of no ids.  Repeated rows give
repeated results.  A null id stays null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxloom.llm import common, tokenizers_

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512

KEY = ["doc_id", "text_hash", "text_len"]


def _cut(docs: DataFrame, id_col: str, text_col: str, chunk_chars: int) -> tuple[DataFrame, DataFrame]:
    """doc_id and text of the rows that are one chunk, and of the longer ones."""
    common.prepare(docs.sparkSession)
    d = common.id_text(docs, id_col, text_col)
    return d.filter(F.length("text") <= chunk_chars), d.filter(F.length("text") > chunk_chars)


def _columns(b: pa.RecordBatch) -> list[list]:
    return [c.to_pylist() for c in b.columns]


def _boundaries(words, text: str, whole: bool) -> list[int]:
    """Ends of the text's pre-tokens that hold whatever follows; whole: nothing does.

    A pre-token that touches the end may go on behind it.  White space is split by
    what follows it, which a stretch that ends there would not see: no stitch after it.
    """
    return [e for m in words.finditer(text) if ((e := m.end()) < len(text) or whole) and not text[e - 1].isspace()]


def split_chunks(long: DataFrame, path: str, pattern: str, chunk_chars: int, overlap_chars: int) -> DataFrame:
    """KEY, copies, chunk, text, head, tail: chunks with their boundaries in the overlaps before and after them; a written table.

    Equal rows (id and text) are one, copies says how many there are.
    """
    cut_schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("text_len", pa.int32()), ("chunk", pa.int32()), ("text", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, text_hash, t in zip(*_columns(b), strict=True):
                starts = range(0, len(t), chunk_chars)
                for i in range(0, len(starts), common.ARROW_ROWS):
                    some = starts[i : i + common.ARROW_ROWS]
                    k = len(some)
                    columns = [[doc_id] * k, [text_hash] * k, [len(t)] * k, [x // chunk_chars for x in some], [t[x : x + chunk_chars + overlap_chars] for x in some]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, cut_schema, strict=True)], schema=cut_schema)

    chunks = long.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(cut, "doc_id long, text_hash long, text_len int, chunk int, text string")
    # Long texts' chunks go to tasks of their own; the key spreads them.
    chunks = chunks.repartition(*KEY, "chunk").sortWithinPartitions(*KEY, "chunk")
    out_schema = pa.schema([
        ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("text_len", pa.int32()), ("copies", pa.int64()), ("chunk", pa.int32()), ("text", pa.string()),
        ("head", pa.list_(pa.int32())), ("tail", pa.list_(pa.int32())),
    ])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizers_.byte_bpe(path, pattern).words
        for (doc_id, text_hash, n, no), rows in _groups(batches, (*KEY, "chunk")):
            t = next(rows)["text"]
            ends = _boundaries(words, t, no * chunk_chars + len(t) >= n)
            head, tail = [0, *(e for e in ends if e <= overlap_chars)], [e - chunk_chars for e in ends if e >= chunk_chars]  # where a chunk starts, it may be stitched
            yield _row(out_schema, (doc_id, text_hash, n, 1 + sum(1 for _ in rows), no, t, head, tail))

    return common.written(chunks.mapInArrow(split, "doc_id long, text_hash long, text_len int, copies long, chunk int, text string, head array<int>, tail array<int>"), "chunks")


def _same(a: str, b: str, *names: str) -> Column:
    same = F.lit(True)
    for n in names:
        same = same & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return same


def _with_runs(seams: DataFrame) -> DataFrame:
    """seams with run (ascending from 1) and next_cut, where the next run begins in this chunk's overlap; null within a run."""
    order = Window.partitionBy(*KEY).orderBy("chunk")
    return seams.withColumn("run", F.count("cut").over(order)).withColumn("next_cut", F.lead("cut").over(order))


def stitches(chunks: DataFrame, path: str, pattern: str, chunk_chars: int, overlap_chars: int) -> DataFrame:
    """KEY, chunk, cut: the boundary in each chunk at which it takes over from the one before; null where it is glued to that."""
    order = Window.partitionBy(*KEY).orderBy("chunk")
    met = F.array_min(F.array_intersect(F.lag("tail").over(order), F.col("head")))
    seams = common.written(chunks.select(*KEY, "chunk", F.when(F.col("chunk") == 0, F.lit(0)).otherwise(met).alias("cut")), "seams")
    key = "doc_id long, text_hash long, text_len int"
    out_schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("text_len", pa.int32()), ("chunk", pa.int32())])

    def disproved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizers_.byte_bpe(path, pattern).words
        for (doc_id, text_hash, n, _), rows in _groups(batches, (*KEY, "run")):
            parts, size, last = [], 0, None
            for r in rows:
                parts.append(r["text"][(r["cut"] or 0) : chunk_chars])
                size, last = size + len(parts[-1]), r
            ends = _boundaries(words, "".join([*parts, last["text"][chunk_chars:]]), False)
            if size + last["next_cut"] not in ends:
                yield _row(out_schema, (doc_id, text_hash, n, last["chunk"] + 1))

    glue = 1
    while True:
        runs = _with_runs(seams)
        several = runs.groupBy(*KEY, "run").agg(F.count("*").alias("n"), F.max("next_cut").alias("end")).filter("n > 1 AND end IS NOT NULL")
        todo = runs.alias("r").join(several.alias("s"), _same("r", "s", *KEY, "run"), "left_semi").alias("t")
        found = chunks.alias("c").join(todo, _same("c", "t", *KEY, "chunk")).select(*(f"c.{k}" for k in KEY), "t.run", "t.chunk", "t.cut", "t.next_cut", "c.text")
        found = found.repartition(*KEY, "run").sortWithinPartitions(*KEY, "run", "chunk")
        wrong = common.written(found.mapInArrow(disproved, f"{key}, chunk int"), "wrong")
        if wrong.isEmpty():
            return seams
        gone = wrong.select(*KEY, F.explode(F.sequence(F.col("chunk"), F.col("chunk") + (glue - 1))).alias("chunk")).distinct().withColumn("gone", F.lit(True))
        joined = seams.alias("s").join(gone.alias("g"), _same("s", "g", *KEY, "chunk"), "left")
        seams = common.written(joined.select(*(f"s.{k}" for k in (*KEY, "chunk")), F.when(F.col("g.gone").isNull(), F.col("s.cut")).alias("cut")), "seams")
        glue *= 2


def stitched(long: DataFrame, path: str, pattern: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Encoded stretches of long texts: KEY, copies, run (ascending from 1), ids binary (unsigned, 32 bits, little-endian)."""
    chunks = split_chunks(long, path, pattern, chunk_chars, overlap_chars)
    runs = _with_runs(stitches(chunks, path, pattern, chunk_chars, overlap_chars)).alias("t")
    found = chunks.alias("c").join(runs, _same("c", "t", *KEY, "chunk")).select(*(f"c.{k}" for k in (*KEY, "copies")), "t.run", "t.chunk", "t.cut", "t.next_cut", "c.text")
    found = found.repartition(*KEY, "run").sortWithinPartitions(*KEY, "run", "chunk")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizers_.byte_bpe(path, pattern)
        for key, rows in _groups(batches, (*KEY, "copies", "run")):
            ids = enc.encode("".join(r["text"][r["cut"] or 0 : chunk_chars + (r["next_cut"] or 0)] for r in rows))
            yield _row(ENCODED, (*key, tokenizers_.packed(ids)))

    return found.mapInArrow(pieces, "doc_id long, text_hash long, text_len int, copies long, run long, ids binary")


ENCODED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("text_len", pa.int32()), ("copies", pa.int64()), ("run", pa.int64()), ("ids", pa.binary())])


def _row(schema: pa.Schema, values: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(values, schema, strict=True)], schema=schema)


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows of sorted batches by key, read one at a time."""
    rows = (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist())
    yield from groupby(rows, key=lambda r: tuple(r[n] for n in names))


def encode(docs: DataFrame, path: str, pattern: str, id_col="doc_id", text_col="text", chunk_chars=CHUNK_CHARS, overlap_chars=OVERLAP_CHARS) -> DataFrame:
    """doc_id, ids array<int> of each row of docs."""
    short, long = _cut(docs, id_col, text_col, chunk_chars)

    def encoder():
        enc = tokenizers_.byte_bpe(path, pattern)
        return lambda b: {"doc_id": b["doc_id"], "ids": [np.asarray(enc.encode(t), "<i4") for t in b["text"]]}

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for key, rows in _groups(batches, (*KEY, "copies")):
            ids = np.frombuffer(b"".join(r["ids"] for r in rows), "<i4")
            for _ in range(key[3]):
                yield _row(schema, (key[0], ids))

    runs = stitched(long, path, pattern, chunk_chars, overlap_chars)
    whole = runs.repartition(*KEY).sortWithinPartitions(*KEY, "run").mapInArrow(joined, "doc_id long, ids array<int>")
    return common.by_batch(short, "doc_id long, ids array<int>", encoder).unionByName(whole)


def decode(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids -> doc_id, bytes binary."""

    def decoder():
        enc = tokenizers_.byte_bpe(path, pattern)
        return lambda b: {"doc_id": b["doc_id"], "bytes": [enc.decode(x or []) for x in b["ids"]]}

    return common.by_batch(ids.select("doc_id", "ids"), "doc_id long, bytes binary", decoder)


def digests(docs: DataFrame, path: str, pattern: str, id_col="doc_id", text_col="text", chunk_chars=CHUNK_CHARS, overlap_chars=OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode where the text lies."""
    short, long = _cut(docs, id_col, text_col, chunk_chars)
    columns = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def digest():
        enc = tokenizers_.byte_bpe(path, pattern)

        def of(b: dict) -> dict:
            ids = [enc.encode(t) for t in b["text"]]
            return {
                "doc_id": b["doc_id"], "n_tokens": list(map(len, ids)),
                "ids_sha256": [hashlib.sha256(tokenizers_.packed(x)).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(enc.decode(x)).hexdigest() for x in ids],
            }

        return of

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizers_.byte_bpe(path, pattern)
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        for key, rows in _groups(batches, (*KEY, "copies")):
            n, a, d = 0, hashlib.sha256(), hashlib.sha256()
            for r in rows:
                a.update(r["ids"])
                ids = np.frombuffer(r["ids"], "<u4").tolist()
                d.update(enc.decode(ids))
                n += len(ids)
            for _ in range(key[3]):
                yield _row(schema, (key[0], n, a.hexdigest(), d.hexdigest()))

    runs = stitched(long, path, pattern, chunk_chars, overlap_chars)
    whole = runs.repartition(*KEY).sortWithinPartitions(*KEY, "run").mapInArrow(summed, columns)
    return common.by_batch(short, columns, digest).unionByName(whole)
