"""Packing of documents into sequences by minimum bin slack.

Each task packs the documents it reads, in windows of bounded tokens, without a
shuffle.  A document longer than a sequence fills whole sequences first; what is
left of it joins the window's remaining lengths.  Each sequence then takes the
longest remainder and the multiset of others that comes closest to the rest of
its room: bitset subset-sum dynamic programming over the distinct lengths with
their counts split in binary, stopped once the exact sum is reached, and traced
back to the counts taken.  Slack that no multiset closes is filled by cutting
the longest remainder left.  Remainders below one sequence are carried to the
next window; a task's last ones become sequences of powers of two, which need no
padding.

Nulls, empties: a null or empty text is a document of its end id alone.
Repeated rows are packed each.  A null id stays null.  An empty table gives no
pieces.  The result follows the rows' order within each input partition, so a
lost task is repeated alike.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fluxloom.llm import common, tokenizers_

SEQUENCE, END_ID = 4096, 2
#: Tokens that a task holds and packs at a time.
WINDOW_TOKENS = 2_000_000

Piece = tuple[int, int, int, int, int]  # document, start, length, sequence, offset


def closest(lengths: dict[int, int], room: int) -> dict[int, int]:
    """The multiset out of lengths (length -> count) with the largest sum up to room, as length -> count."""
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for n in sorted(lengths, reverse=True):
        left, take = min(lengths[n], room // n), 1
        while left > 0:
            k = min(take, left)
            more = (reach | reach << (n * k)) & mask
            if more != reach:
                steps.append((n, k, reach))
                reach = more
            left, take = left - k, take * 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, defaultdict(int)
    for n, k, before in reversed(steps):
        if not before >> at & 1:  # reached by this step alone
            out[n] += k
            at -= n * k
    return dict(out)


class Packer:
    """Packs documents given by their lengths; pieces come window by window."""

    def __init__(self, size: int = SEQUENCE, first_sequence: int = 0):
        self.size, self.sequence = size, first_sequence
        self.rest: dict[int, list[tuple[int, int]]] = defaultdict(list)  # length -> documents and starts
        self.total = 0

    def add(self, doc: int, n: int) -> Iterator[Piece]:
        start = 0
        while n - start >= self.size:
            yield doc, start, self.size, self._next(), 0
            start += self.size
        if n > start:
            self.rest[n - start].append((doc, start))
            self.total += n - start

    def _next(self) -> int:
        self.sequence += 1
        return self.sequence - 1

    def _take(self, n: int) -> tuple[int, int]:
        held = self.rest[n]
        out = held.pop()
        if not held:
            del self.rest[n]
        self.total -= n
        return out

    def _cut(self, room: int) -> tuple[int, int, int]:
        """Up to room tokens of the longest remainder: document, start, length."""
        n = max(self.rest)
        doc, start = self._take(n)
        k = min(n, room)
        if n > k:
            self.rest[n - k].append((doc, start + k))
            self.total += n - k
        return doc, start, k

    def full(self) -> Iterator[Piece]:
        """Sequences without slack, as long as the remainders fill one."""
        while self.total >= self.size:
            n = max(self.rest)
            chosen = [(*self._take(n), n)]
            for k, count in closest({a: len(b) for a, b in self.rest.items()}, self.size - n).items():
                chosen += [(*self._take(k), k) for _ in range(count)]
            at, seq = 0, self._next()
            for doc, start, k in chosen:
                yield doc, start, k, seq, at
                at += k
            while at < self.size:
                doc, start, k = self._cut(self.size - at)
                yield doc, start, k, seq, at
                at += k

    def last(self) -> Iterator[Piece]:
        """What is left, in sequences of powers of two."""
        yield from self.full()
        while self.total:
            room = 1 << (self.total.bit_length() - 1)
            at, seq = 0, self._next()
            while at < room:
                doc, start, k = self._cut(room - at)
                yield doc, start, k, seq, at
                at += k


def pack(
    docs: DataFrame, path: str, size: int = SEQUENCE, end_id: int = END_ID, window_tokens: int = WINDOW_TOKENS,
    with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece, and its ids on demand.

    sequence_id holds the input partition above 2^32 and counts below it.
    """
    d = common.id_text(docs, id_col, text_col)
    common.prepare(d.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = pa.schema([(n, pa.int64()) for n in names] + [("ids", pa.list_(pa.int64()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = tokenizers_.word_bpe_json(path), end_id.to_bytes(4, "little")
        packer = Packer(size, TaskContext.get().partitionId() << 32)
        held: dict[int, tuple[int | None, bytes]] = {}
        pieces: list[Piece] = []

        def out() -> pa.RecordBatch:
            cut = [held[p[0]][1][4 * p[1] : 4 * (p[1] + p[2])] for p in pieces]
            columns = [
                [held[p[0]][0] for p in pieces], [p[1] for p in pieces], [p[2] for p in pieces], list(map(zlib.crc32, cut)),
                [len(held[p[0]][1]) // 4 for p in pieces], [p[3] for p in pieces], [p[4] for p in pieces],
            ]
            if with_ids:
                columns.append([memoryview(c).cast("I").tolist() for c in cut])
            pieces.clear()
            kept = {doc for left in packer.rest.values() for doc, _ in left}
            for k in held.keys() - kept:
                del held[k]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        row = 0
        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode_all(b.column(1).to_pylist()), strict=True):
                ids += end
                held[row] = (doc_id, ids)
                pieces.extend(packer.add(row, len(ids) // 4))
                row += 1
                if packer.total >= window_tokens or len(pieces) >= 20_000:
                    pieces.extend(packer.full())
                    yield out()
        pieces.extend(packer.last())
        if pieces:
            yield out()

    return d.mapInArrow(run, ", ".join(f"{n} long" for n in names) + ", ids array<long>" * with_ids)
