"""Toxicity by compression distance between zstandard dictionaries.

A text is cut into windows of at most WINDOW bytes at white space, lower-cased
and otherwise as they are.  Each window is compressed with a dictionary of
ordinary text and with one of toxic text; the gain is how many bytes the toxic
one saves.  As one word costs a few bytes more or less by chance, PAIRS pairs of
dictionaries are trained on other samples each, and a window has a gain, their
mean, if every pair gains: at the first that doesn't, the window is done.  It
counts if its gain is above what all but one of a hundred windows of ordinary
calibration texts reach; the text's distance is the sum of
those gains over its windows and ALLOWANCE more, so its length doesn't decide,
and a passage counts by its share of the text.

A pair shares its base, so that common prose costs the same under both: raw
windows of ordinary texts, the ordinary dictionary.  The toxic one goes on with
stretches of toxic texts that the base can't explain.  These are found by
compression alone, over ROUNDS rounds in two folds: a fold's windows are
compressed with the other fold's dictionary (at first its raw text, then the
stretches found so far), windows with a high gain are kept, and of each the
words without which the gain falls by half.  A stretch stays that was found in
MIN_TEXTS texts, and more often than in ordinary windows by CONTRAST; all that
do are kept, whatever their size.  Frequent ones lie last, where a match costs
least.

The score is an isotonic regression of the label on the distance, over labelled
texts that trained no dictionary.  What bounds fitting are parameters of fit():
at most max_toxic and max_ordinary labelled texts, whole, those whose id hashes
lowest, without near copies, a third of which calibrate; base_bytes of ordinary
windows, drawn at random, in every dictionary; and side_bytes of the other fold's
in the first round.  Scoring takes every window of every text.

Nulls, empties: a null or empty text has distance 0.  A null id is in no fold
that is held out and has no label.  Labels that are null are no labels; of
several for an id the highest counts.  Without labels of both kinds every score
is the share of toxic labels, or 0 without any; too few toxic texts to find a
stretch twice give distance 0 everywhere.  Repeated rows give repeated results.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxloom.llm import common

WINDOW, BASE_BYTES, SIDE_BYTES = 96, 40_000, 65_536
PAIRS, ROUNDS, MIN_TEXTS, CONTRAST = 4, 3, 3, 4.0
#: Ordinary windows that a training round is held against (or a sixth of the toxic ones), the share of them that stays below its threshold, and that below the final one.
REFERENCE, ROUND_SHARE, FINAL_SHARE = 4_000, 0.9, 0.99
MAX_TOXIC, MAX_ORDINARY = 1500, 3000
#: Windows without a gain that every text is given besides its own.
ALLOWANCE = 3
PREDICTED = 0.7
#: Words of a shingle and hashes of a sketch, by which near copies are told in the sample.
SHINGLE, SKETCH = 5, 16

WORD = re.compile(r"\w+")
_WINDOW = re.compile(rb"(?s).{1,%d}(?:\s|\Z)|.{%d}" % (WINDOW, WINDOW))


def windows(text: str) -> list[bytes]:
    """The text's bytes in windows that end at white space; a longer word is cut."""
    return [b" " + w for w in _WINDOW.findall(text.lower().encode("utf-8", "replace"))]


def compressor(content: bytes):
    """Bytes -> compressed bytes with a dictionary of this content."""
    import zstandard as z

    log = max(17, len(content).bit_length() + 1)
    p = z.ZstdCompressionParameters(
        window_log=log, chain_log=log, hash_log=log, search_log=5, min_match=4, target_length=32, strategy=z.STRATEGY_LAZY2,
        format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return z.ZstdCompressor(compression_params=p, dict_data=d).compress


@dataclass
class Model:
    """Contents of the ordinary and the toxic dictionary of each pair, the threshold of a window's gain, and the score at each distance: that of the last step at or below it."""

    pairs: list[tuple[bytes, bytes]] = field(default_factory=list)
    threshold: float = 0.0
    steps: list[float] = field(default_factory=lambda: [-np.inf])
    scores: list[float] = field(default_factory=lambda: [0.0])

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, m: Model):
        self.steps, self.scores, self.threshold = np.array(m.steps), np.array(m.scores), m.threshold
        self.pairs = [(compressor(a), compressor(b)) for a, b in m.pairs]

    def gain(self, window: bytes) -> float:
        total = 0
        for pair in self.pairs:
            g = _gain(pair, window)
            if g <= 0:
                return 0.0
            total += g
        return total / len(self.pairs)

    def distance(self, text: str) -> float:
        if not self.pairs:
            return 0.0
        gains = list(map(self.gain, windows(text)))
        return sum(g for g in gains if g > self.threshold) / (len(gains) + ALLOWANCE)

    def score(self, texts) -> np.ndarray:
        d = np.array([self.distance(t) for t in texts], np.float64)
        return self.scores[np.searchsorted(self.steps, d, side="right") - 1]


def isotonic(x: list[float], y: list[int]) -> tuple[list[float], list[float]]:
    """Steps of the best nondecreasing fit of y on x, each block pulled toward the whole by one row."""
    prior = sum(y) / len(y)
    blocks: list[list[float]] = []  # first x, sum of y, rows
    at: dict[float, list[int]] = {}
    for a, b in zip(x, y, strict=True):
        at.setdefault(a, []).append(b)
    for a in sorted(at):
        blocks.append([a, sum(at[a]), len(at[a])])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            _, s, n = blocks.pop()
            blocks[-1][1] += s
            blocks[-1][2] += n
    scores = np.maximum.accumulate([(s + prior) / (n + 1) for _, s, n in blocks])
    return [-np.inf, *(b[0] for b in blocks[1:])], scores.tolist()


def near_copies_out(texts: list[str]) -> list[int]:
    """Indices of texts that aren't near copies of earlier ones: a group of copies would teach its own words.

    Of a text's least shingle hashes, half are known for a near copy; texts of
    few words are kept.
    """
    import xxhash

    seen: set[int] = set()
    out = []
    for i, t in enumerate(texts):
        w = WORD.findall(t.lower())
        least = sorted({xxhash.xxh3_64_intdigest(" ".join(w[j : j + SHINGLE])) for j in range(len(w) - SHINGLE + 1)})[:SKETCH]
        if not least or 2 * sum(h in seen for h in least) < len(least):
            out.append(i)
        seen.update(least)
    return out


def _taken(pool: Iterable[bytes], size: int) -> tuple[bytes, int]:
    """Windows of the pool up to size bytes, and how many."""
    out, n = [], 0
    for w in pool:
        if n + len(w) > size:
            break
        out.append(w)
        n += len(w)
    return b"".join(out), len(out)


def _stretches(pair: tuple, window: bytes, gain: int) -> list[bytes]:
    """Words in a row of a window without which half its gain is lost."""
    words, out, row = window.split(b" "), [], []
    for i, w in enumerate(words):
        rest = b" ".join(words[:i] + words[i + 1 :])
        if w and 2 * (gain - _gain(pair, rest)) >= gain:
            row.append(w)
        elif row:
            out.append(b" " + b" ".join(row) + b" ")
            row = []
    return out + [b" " + b" ".join(row) + b" "] * bool(row)


def _gain(pair: tuple, window: bytes) -> int:
    return len(pair[0](window)) - len(pair[1](window))


def _dictionary(found: Iterable[tuple[int, bytes]], ordinary: Counter, fair: float) -> bytes:
    """Stretches found in enough texts, and over CONTRAST times as often as by the fair share of ordinary windows; the most frequent last."""
    texts = defaultdict(set)
    for text, stretch in found:
        texts[stretch].add(text)
    good = [(len(t), s) for s, t in texts.items() if len(t) >= MIN_TEXTS and len(t) > CONTRAST * fair * ordinary[s]]
    return b"".join(s for _, s in sorted(good))


def train_pair(toxic: list[list[bytes]], ordinary: list[list[bytes]], seed: int, base_bytes: int = BASE_BYTES, side_bytes: int = SIDE_BYTES) -> tuple[bytes, bytes]:
    """Contents of an ordinary and a toxic dictionary, from the windows of each text."""
    rnd = random.Random(seed)
    pool = [w for t in ordinary for w in t]
    rnd.shuffle(pool)
    n_toxic = sum(map(len, toxic))
    n = min(max(REFERENCE, n_toxic // 6), len(pool) // 3)
    reference, pool = pool[:n], pool[n:]
    base, k = _taken(pool, base_bytes)
    folds, more = [toxic[0::2], toxic[1::2]], b"".join(pool[k:])
    sides = []
    for fold in folds:
        w = [w for t in fold for w in t]
        rnd.shuffle(w)
        sides.append(_taken(w, side_bytes)[0])
    found: list[list[tuple[int, bytes]]] = [[], []]
    for i in range(ROUNDS):
        usual: Counter = Counter()
        for f in (0, 1):
            side = sides[1 - f]
            # In the first round the toxic side is raw text: the ordinary one gets as much of its own.
            pair = compressor(base + (more[: len(side)] if i == 0 else b"")), compressor(base + side)
            gains = [_gain(pair, w) for w in reference]
            floor = max(1.0, float(np.quantile(gains, ROUND_SHARE))) if gains else 1.0
            usual.update(s for g, w in zip(gains, reference, strict=True) if g > floor for s in _stretches(pair, w, g))
            found[f] = [(2 * j + f, s) for j, t in enumerate(folds[f]) for w in t if (g := _gain(pair, w)) > floor for s in _stretches(pair, w, g)]
        # Ordinary windows are seen twice, once for each fold's pair.
        fair = n_toxic / max(1, 2 * len(reference))
        sides = [_dictionary(x, usual, fair / 2) for x in found]
    return base, base + _dictionary(found[0] + found[1], usual, fair)


def train(texts: list[str], toxic: list[int], pairs: int = PAIRS, base_bytes: int = BASE_BYTES, side_bytes: int = SIDE_BYTES) -> Model:
    """A model of labelled texts in a random order, without near copies; every third calibrates."""
    kept = near_copies_out(texts)
    texts, toxic = [texts[i] for i in kept], [toxic[i] for i in kept]
    if len(set(toxic)) < 2:
        return Model(scores=[float(toxic[0]) if toxic else 0.0])
    cut = [windows(t) for t in texts]
    build = [i for i in range(len(texts)) if i % 3]
    sides = [[cut[i] for i in build if toxic[i] == y] for y in (1, 0)]
    found = [train_pair(*sides, seed, base_bytes, side_bytes) for seed in range(pairs)]
    m = Model([(a, b) for a, b in found if a != b])
    s, rest = m.scorer(), [i for i in range(len(texts)) if i % 3 == 0]
    if m.pairs:
        gains = [s.gain(w) for i in rest if not toxic[i] for w in cut[i]]
        m.threshold = s.threshold = max(1.0, float(np.quantile(gains, FINAL_SHARE))) if gains else 1.0
    m.steps, m.scores = isotonic([s.distance(texts[i]) for i in rest], [toxic[i] for i in rest])
    return m


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY, base_bytes: int = BASE_BYTES, side_bytes: int = SIDE_BYTES,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Model:
    """Ids are chosen from the labels first, so that texts of the sample alone are moved."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("y IS NOT NULL AND doc_id IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).filter(~held_out())
    order = F.xxhash64("doc_id")
    chosen = known.filter("y = 1").orderBy(order, "doc_id").limit(max_toxic).unionByName(known.filter("y = 0").orderBy(order, "doc_id").limit(max_ordinary))
    rows = common.id_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("text", "y").groupBy("text").agg(F.max("y").alias("y"))
    got = sorted(((_mixed(r.text), r.text, r.y) for r in rows.toLocalIterator()))
    return train([t for _, t, _ in got], [y for _, _, y in got], PAIRS, base_bytes, side_bytes)


def _mixed(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text, 9)


def scores(text: Column, model: Model) -> Column:
    @F.pandas_udf("double")
    def of(batches: pd.Series) -> pd.Series:
        return pd.Series(_scorer(model).score(batches))

    return of(F.coalesce(text, F.lit("")))


_scorers: dict[bytes, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    """A worker's scorer of a model, set up once."""
    key = b"".join(b for _, b in model.pairs) + repr((model.threshold, model.scores)).encode()
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = model.scorer()
    return _scorers[key]


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    d = common.id_text(docs, id_col, text_col)
    common.prepare(d.sparkSession)
    s = d.select("doc_id", scores(F.col("text"), model).alias("score"))
    return s.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICTED).cast("int").alias("predicted"))


def rejected(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows that are predicted toxic, columns as they were."""
    common.prepare(docs.sparkSession)
    return docs.filter(scores(F.col(text_col), model) < PREDICTED)
