"""Token counts by a two-tier lookup on the map side; no pre-token is shuffled.

A pre-token is a run of spaces with the run of other characters behind it; no
piece of the vocabulary crosses the start of such a run (checked when the model
loads).  Tier one is a broadcast table of the corpus's frequent pre-tokens and
their token counts.  Its words come from summaries: each task counts its
pre-tokens in bounded memory, dropping entries seen least, so a summary's counts
are lower bounds.  Summaries are merged FAN_IN at a time, level by level, and the
driver gets FAN_IN at most.  The table decides speed alone: a miss goes to the
worker's own cache, and then to the library.

Nulls, empties: a null or empty text has 0 bytes and 0 tokens.  Repeated rows
give repeated results.  A null id stays null.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.llm import common, tokenizers_

#: Pre-tokens in the broadcast table; with counts they take under 3 MB.
TABLE_ENTRIES = 65_536
#: Pre-tokens that a task counts at a time, and that its summary keeps.
TASK_ENTRIES, SUMMARY_ENTRIES = 200_000, 16_384
#: Longest pre-token that is counted or cached, in characters.
WORD_CHARS = 48
#: Summaries that one task, or the driver, merges.
FAN_IN = 16

_SPACES = "▁"  # the library's own sign for a space
_UNITS = re.compile(r"[ ▁]*[^ ▁]+|[ ▁]+")


def units(text: str) -> list[str]:
    """Pre-tokens of a text, each without its first space; the library puts that one before what it encodes."""
    parts = text.split(" ")
    if "" not in parts and _SPACES not in text:
        return parts
    first, *rest = _UNITS.findall(text) or [""]
    return [first, *(u[1:] for u in rest)]


class PieceCounter:
    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.lib.id_to_piece, range(self.lib.get_piece_size()))
        if any(_SPACES in p.lstrip(_SPACES) for p in pieces):
            raise ValueError("a piece of this model crosses white space")
        self.space = len(self.lib.encode("a ")) - len(self.lib.encode("a"))
        self.cache: dict[str, int] = {}

    def lengths(self, words: list[str]) -> dict[str, int]:
        return dict(zip(words, map(len, self.lib.encode(words, num_threads=1)), strict=True)) if words else {}

    def count(self, text: str, table: dict[str, int]) -> int:
        if not text:
            return 0
        words, n = units(text), 0
        if len(words) > 1 and not words[-1]:  # one space at the end is a piece by itself
            words.pop()
            n = self.space
        found = list(map(table.get, words))
        if None not in found:
            return n + sum(found)
        cache = self.cache
        if len(cache) > tokenizers_.CACHE_ENTRIES:
            cache.clear()
        missed = [w for w, k in zip(words, found, strict=True) if k is None]
        got = self.lengths([w for w in dict.fromkeys(missed) if w not in cache])
        cache.update((w, k) for w, k in got.items() if len(w) <= WORD_CHARS)
        return n + sum(k for k in found if k is not None) + sum(cache[w] if w in cache else got[w] for w in missed)


@lru_cache(maxsize=1)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def _pruned(c: Counter, n: int) -> Counter:
    return c if len(c) <= n else Counter(dict(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:n]))


def frequent(docs: DataFrame, entries: int = TABLE_ENTRIES) -> list[str]:
    """The corpus's frequent pre-tokens by merged summaries; docs: doc_id, text."""
    common.prepare(docs.sparkSession)

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                seen.update(units(t))
                if len(seen) > 2 * TASK_ENTRIES:
                    seen = _pruned(seen, TASK_ENTRIES)
        if seen:
            top = _pruned(Counter({w: k for w, k in seen.items() if k > 1 and len(w) <= WORD_CHARS}), SUMMARY_ENTRIES)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([pickle.dumps(dict(top))])], names=["part", "summary"])

    def merged(table: pa.Table) -> pa.Table:
        total: Counter = Counter()
        for s in table.column("summary"):
            total = _pruned(total + Counter(pickle.loads(s.as_py())), 4 * entries)
        return pa.table({"part": pa.array([table.column("part")[0].as_py() // FAN_IN], pa.int64()), "summary": [pickle.dumps(dict(_pruned(total, entries)))]})

    rows = common.written(docs.select("text").mapInArrow(summary, "part long, summary binary"), "summaries")
    tasks = (rows.agg(F.max("part")).first()[0] or 0) + 1
    while tasks > FAN_IN:
        rows = rows.groupBy(F.floor(F.col("part") / FAN_IN).alias("g")).applyInArrow(merged, "part long, summary binary")
        tasks = -(-tasks // FAN_IN)
    total: Counter = Counter()
    for r in rows.toLocalIterator():
        total = _pruned(total + Counter(pickle.loads(r.summary)), 4 * entries)
    return sorted(_pruned(total, entries))


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", entries: int = TABLE_ENTRIES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row."""
    d = common.id_text(docs, id_col, text_col)
    table = d.sparkSession.sparkContext.broadcast(counter(path).lengths(frequent(d, entries)))

    def make():
        c, known = counter(path), table.value

        def of(b: dict) -> dict:
            n = [c.count(t, known) for t in b["text"]]
            return {"doc_id": b["doc_id"], "n_bytes": [len(t.encode()) for t in b["text"]], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return of

    return common.by_batch(d, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", make)
