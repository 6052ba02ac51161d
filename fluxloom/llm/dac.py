"""Token ids in directly addressable codes.

A shard codes a run of ids: every id is split into chunks of CHUNK_BITS, lowest
first.  Level k holds the k-th chunks of the ids that have one, one byte each,
and a bitmap that says which of them go on.  A directory holds the number of set
bits before every 512 bits of a bitmap, so the rank of a bit, and with it an
id's place in the next level, takes one directory entry and at most 64 bytes of
bitmap: any id can be read without decoding others.

A shard's bytes: magic, ids, levels; for each level its length, chunks, and but
for the last bitmap and directory.  Numbers are little-endian.

write() encodes documents where they lie, deals the ids (two bytes each where
they fit) into ranges of document ids, and writes shards through Spark's writer,
so any store that Spark reaches will do and a lost task leaves nothing.  There are
as many ranges as a shuffle has partitions, or more where a range would hold over
RANGE_BYTES of text, up to MAX_RANGES; beyond these a range grows, but is still
sorted and written as a stream.  Their bounds cut a sample of SAMPLE documents a
range, those whose hash is least, into equal sizes of text.  Nulls, empties: a null or empty text is its end id alone; null ids
come first.  Equal ids follow by the text's hash, and rows equal in both are
spread over the ranges that they fill.  An empty table gives no shards.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.llm import common, tokenizers_

MAGIC, CHUNK_BITS, BLOCK_BITS = b"DAC1", 8, 512
END_ID = 2
#: Ids after which a task starts a new shard.
SHARD_TOKENS = 1_000_000
#: Documents for each range that decide its bounds; text of a range; and how many there are at most.
SAMPLE, RANGE_BYTES, MAX_RANGES = 20, 256 << 20, 20_000


def encode(ids: np.ndarray) -> bytes:
    """The bytes of a shard."""
    rest = np.asarray(ids, np.uint32)
    levels = []
    while True:
        on = rest >= 1 << CHUNK_BITS
        chunk = (rest & ((1 << CHUNK_BITS) - 1)).astype(np.uint8).tobytes()
        if not on.any():
            levels.append(struct.pack("<Q", len(rest)) + chunk)
            break
        bits = np.packbits(on, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK_BITS // 8), np.uint8)])
        counts = np.bitwise_count(bits.reshape(-1, BLOCK_BITS // 8)).sum(axis=1, dtype=np.uint32)
        directory = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4")
        levels.append(struct.pack("<Q", len(rest)) + chunk + bits.tobytes() + directory.tobytes())
        rest = rest[on] >> CHUNK_BITS
    return MAGIC + struct.pack("<QI", len(ids), len(levels)) + b"".join(levels)


class Shard:
    """Random access to the ids of a shard's bytes."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard")
        self.n, levels = struct.unpack_from("<QI", data, 4)
        self.levels, at = [], 16
        for k in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            chunk, at = np.frombuffer(data, np.uint8, n, at + 8), at + 8 + n
            if k == levels - 1:
                self.levels.append((chunk, None, None))
                break
            blocks = -(-n // BLOCK_BITS)
            bits, at = np.frombuffer(data, np.uint8, blocks * BLOCK_BITS // 8, at), at + blocks * BLOCK_BITS // 8
            directory, at = np.frombuffer(data, "<u4", blocks, at), at + 4 * blocks
            self.levels.append((chunk, bits, directory))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """One id, by one rank in each level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunk, bits, directory in self.levels:
            value |= int(chunk[i]) << shift
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self._rank(bits, directory, i), shift + CHUNK_BITS
        return value

    @staticmethod
    def _rank(bits: np.ndarray, directory: np.ndarray, i: int) -> int:
        block = i // BLOCK_BITS
        part = bits[block * BLOCK_BITS // 8 : (i >> 3) + 1].copy()
        if len(part) and i < (block + 1) * BLOCK_BITS:
            part[-1] &= (1 << (i & 7)) - 1
        return int(directory[block]) + int(np.bitwise_count(part).sum())

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop: one rank in each level, then neighbours."""
        out = np.zeros(max(0, stop - start), np.uint32)
        where, shift = np.arange(len(out)), 0
        for chunk, bits, directory in self.levels:
            if not len(where):
                break
            out[where] |= chunk[start : start + len(where)].astype(np.uint32) << np.uint32(shift)
            if bits is None:
                break
            own = bits[start >> 3 : (start + len(where) + 7) >> 3]
            on = np.unpackbits(own, bitorder="little")[start & 7 : (start & 7) + len(where)].astype(bool)
            start, where, shift = self._rank(bits, directory, start), where[on], shift + CHUNK_BITS
        return out


SHARDS = "part int, first long, tokens long, doc_ids array<long>, lengths array<long>, shard binary"


def _order(doc_id: int | None, text_hash: int) -> tuple:
    return doc_id is not None, doc_id or 0, text_hash


def ranges(d: DataFrame, least: int, range_bytes: int = RANGE_BYTES, sample: int = SAMPLE) -> list[tuple]:
    """Bounds of so many ranges of doc_id and text_hash, or more of a larger table, of about equal size of text."""

    def drawn(n: int) -> list[tuple[tuple, int]]:
        rows = d.select("doc_id", "text_hash", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id", "text_hash", F.lit(7)), "doc_id", "text_hash").limit(sample * n)
        return sorted((_order(r.doc_id, r.text_hash), r.n + 1) for r in rows.collect())

    rows = drawn(least)
    if not rows:
        return []
    size = d.count() * sum(n for _, n in rows) / len(rows)
    n = min(MAX_RANGES, max(least, -int(-size // range_bytes)))
    rows = drawn(n) if n > least else rows
    whole, upto, last, bounds = sum(k for _, k in rows), 0, 0, []
    for at, k in rows:
        # A document that fills several ranges ends one.
        if (now := int((upto + k / 2) * n / whole)) > last:
            bounds.append(at)
            last = now
        upto += k
    return bounds


def write(
    docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES
) -> None:
    """Shards of all documents in ascending id order below path.

    part ascends with the ids; first counts the ids of earlier shards of the part.
    """
    d = common.id_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    spark = d.sparkSession
    common.prepare(spark)
    bounds = ranges(d, int(spark.conf.get("spark.sql.shuffle.partitions")), range_bytes)
    n = len(bounds) + 1

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, seen = tokenizers_.byte_bpe_json(vocabulary), end_id.to_bytes(4, "little"), 0
        for b in batches:
            ids, hashes = b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist()
            coded = [np.frombuffer(x + end, "<u4") for x in enc.encode_all(b.column("text").to_pylist())]
            parts = []
            for doc_id, h in zip(ids, hashes, strict=True):
                at = _order(doc_id, h)
                low, high = bisect_left(bounds, at), bisect_right(bounds, at)
                parts.append(low + seen % (high - low + 1))
                seen += 1
            narrow = [bool(x.max() < 1 << 16) for x in coded]
            data = [x.astype("<u2").tobytes() if small else x.tobytes() for x, small in zip(coded, narrow, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(parts, pa.int32()), pa.array(narrow), pa.array(data, pa.binary())], names=["doc_id", "text_hash", "part", "narrow", "ids"])

    d = d.select("doc_id", "text_hash", "text").mapInArrow(encoded, "doc_id long, text_hash long, part int, narrow boolean, ids binary")
    d = d.repartitionById(n, "part").sortWithinPartitions("doc_id", "text_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
        first, held, ids, n = 0, [], [], 0

        def shard() -> pa.RecordBatch:
            values = (part, first, n, ids, list(map(len, held)), encode(np.concatenate(held)))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["part", "first", "tokens", "doc_ids", "lengths", "shard"])

        for b in batches:
            for doc_id, narrow, data in zip(*(b.column(x).to_pylist() for x in ("doc_id", "narrow", "ids")), strict=True):
                held.append(np.frombuffer(data, "<u2" if narrow else "<u4").astype(np.uint32))
                ids.append(doc_id)
                n += len(held[-1])
                if n >= shard_tokens:
                    yield shard()
                    first, held, ids, n = first + n, [], [], 0
        if held:
            yield shard()

    d.mapInArrow(run, SHARDS).write.option("compression", "uncompressed").parquet(path)


def read(spark, path: str) -> DataFrame:
    """The shards with start, the number of all ids before each."""
    shards = spark.read.schema(SHARDS).parquet(path)
    # One row for each writing task: a few numbers, however large the corpus.
    sizes = shards.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect()
    before, starts = 0, []
    for r in sizes:
        starts.append((r.part, before))
        before += r.n
    offsets = spark.createDataFrame(starts, "part int, before long")
    return shards.join(F.broadcast(offsets), "part").withColumn("start", F.col("before") + F.col("first"))


def digests(docs: DataFrame, vocabulary: str, **more) -> DataFrame:
    """The contract's columns: write shards to the shared folder, and read every document back from them."""
    spark = docs.sparkSession
    path = common.folder(spark, "shards")
    write(docs, path, vocabulary, **more)

    def make():
        def of(b: dict) -> dict:
            out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
            for ids, lengths, data, start in zip(b["doc_ids"], b["lengths"], b["shard"], b["start"], strict=True):
                s, at = Shard(data), 0
                for doc_id, n in zip(ids, lengths, strict=True):
                    for k, v in zip(out, (doc_id, start + at, n, zlib.crc32(s.range(at, at + n).astype("<u4").tobytes())), strict=True):
                        out[k].append(v)
                    at += n
            return out

        return of

    shards = read(spark, path).select("doc_ids", "lengths", "shard", "start")
    return common.by_batch(shards, "doc_id long, start long, n_tokens long, ids_crc32 long", make)
