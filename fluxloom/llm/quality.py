"""Quality rules with adaptive thresholds.

Counts of a text feed fixed base rules and four measures.  For each measure, and
for the lengths of texts, each language and source keeps a mergeable quantile
sketch: counts of logarithmic buckets, so a value's bucket is within
RELATIVE_ERROR of it, sketches merge by adding counts, and the result doesn't
depend on order or retries.  Sketches hold the documents that pass the base rules.

All limits are read off the sketches.  An upper fence lies FENCE quartile
distances above the median, and for the length of words a lower one below it; it
holds up while junk is less than a quarter of a group.  Where the quartile equals
the median (most texts hold no symbol and repeat no line) a share is limited to
one event in a text of the group's median length, the least that its texts could
show at all.  A group is shrunk toward its language, its source and the corpus:
its sketch is its own plus PRIOR_ROWS rows, a third spread as each of these, so a
group of few documents has theirs.

Limits are joined back, and documents beyond any of them, by more than the noise
of a text of their own length, are rejected.  That noise is one event for the
share of lines, one event and three standard deviations of a count at the limit
for shares of words, and three standard errors of the text's own word lengths
for their mean.

Nulls, empties: a null text has no words, all counts 0, and fails the base
rules.  A null language or source is a group of its own.  Repeated rows count
each.  A group of which no document passes the base rules has no limits, and
keeps none.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from operator import mul

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxloom.llm import common

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")

WINDOW_WORDS, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
#: Measures; those that count events in words or lines, and what they count them in.
MEASURES = ("symbols_per_word", "dup_line_share", "echo_share", "chars_per_word")
SHARES = {"symbols_per_word": "n_words", "dup_line_share": "n_lines", "echo_share": "n_words"}
#: Quartile distances from the median to a fence, and standard deviations that are taken for noise.
FENCE, DEVIATIONS = 6.0, 3.0
RELATIVE_ERROR, SMALLEST, PRIOR_ROWS = 0.002, 1e-4, 60

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_echoes long, word_squares long"


def counts(text: str) -> tuple[int, ...]:
    """The numbers of COUNTS; an echo is a word equal to the one before it."""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)] if "\n" in text else [text] if words else []
    n, k = len(words), WINDOW_WORDS
    repeat = 0
    if n > k:
        windows = list(zip(*(words[i:] for i in range(k)), strict=False))
        if len(set(windows)) < len(windows):
            seen, end = Counter(windows), 0
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeat += i + k - max(i, end)
                    end = i + k
    sizes = list(map(len, words))
    return n, sum(sizes), len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeat, len(lines), sum(map(str.__eq__, words, words[1:])), sum(map(mul, sizes, sizes))


def with_counts(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", source_col="source") -> DataFrame:
    """doc_id, lang, source and the counts of each row, one pass over the texts."""
    d = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    names = [c.split()[0] for c in COUNTS.split(", ")]

    def make():
        def of(b: dict) -> dict:
            rows = [counts(t) for t in b["text"]]
            return {k: b[k] for k in ("doc_id", "lang", "source")} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

        return of

    return common.by_batch(d, f"doc_id long, lang string, source string, {COUNTS}", make)


def _measures() -> dict:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "symbols_per_word": per("n_symbols", "n_words"), "dup_line_share": per("n_dup_lines", "n_lines"),
        "echo_share": per("n_echoes", "n_words"), "chars_per_word": per("word_chars", "n_words"),
    }


def _gamma() -> float:
    return math.log((1 + RELATIVE_ERROR) / (1 - RELATIVE_ERROR))


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: counts of logarithmic buckets of MEASURES and lengths, added up before the shuffle."""
    bucket = lambda c: F.when(F.col(c) <= SMALLEST, F.lit(0)).otherwise(F.ceil(F.log(F.col(c) / SMALLEST) / _gamma()).cast("int"))
    every = [*MEASURES, "n_words", "n_lines"]
    tall = measured.select("lang", "source", F.explode(F.map_from_arrays(F.array(*map(F.lit, every)), F.array(*map(bucket, every)))).alias("measure", "bucket"))
    return tall.groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def shrunk(sketch: DataFrame) -> DataFrame:
    """The sketch of each group plus PRIOR_ROWS rows, a third each spread as its language, its source and all."""
    groups = sketch.select("lang", "source", "measure").distinct().alias("g")
    out = sketch.select("lang", "source", "measure", "bucket", F.col("n").cast("double").alias("n"))
    for keys in (["lang"], ["source"], []):
        part = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
        share = part.withColumn("n", F.col("n") * (PRIOR_ROWS / 3) / F.sum("n").over(Window.partitionBy(*keys, "measure"))).alias("p")
        same = F.col("g.measure") == F.col("p.measure")
        for k in keys:
            same = same & F.col(f"g.{k}").eqNullSafe(F.col(f"p.{k}"))
        out = out.unionByName(groups.join(share, same).select("g.lang", "g.source", "g.measure", "p.bucket", "p.n"))
    return out.groupBy("lang", "source", "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, at: dict[str, float]) -> DataFrame:
    """Values at the given ranks for each language, source and measure.  A group and measure has some thousand buckets at most, whatever its rows."""
    group = Window.partitionBy("lang", "source", "measure")
    upto = sketch.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("of", F.sum("n").over(group))
    found = upto.groupBy("lang", "source", "measure").agg(
        *(F.min(F.when(F.col("upto") >= F.col("of") * q - 1e-9, F.col("bucket"))).alias(name) for name, q in at.items())
    )
    value = lambda b: F.when(F.col(b) <= 0, F.lit(0.0)).otherwise(F.lit(SMALLEST) * F.exp((F.col(b) - 0.5) * _gamma()))
    return found.select("lang", "source", "measure", *(value(name).alias(name) for name in at))


def thresholds(measured: DataFrame) -> DataFrame:
    """lang, source, <measure>_limit for each, chars_per_word_least, and by_fence, how many of the limits are fences; a written table.

    Its size is known when it is joined, so the optimizer broadcasts it while it
    is small, and shuffles no texts for it.
    """
    # Some thousand rows a group, used several times.
    sketch = common.written(sketches(measured.filter(~base_failed())), "sketches")
    q = quantiles(shrunk(sketch), {"lower": 0.25, "middle": 0.5, "upper": 0.75})
    wide = q.groupBy("lang", "source").pivot("measure", [*MEASURES, "n_words", "n_lines"]).agg(F.first(F.struct("lower", "middle", "upper")))
    spread = lambda m, to="upper": F.col(f"{m}.{to}") - F.col(f"{m}.middle")
    fence = lambda m, to="upper": F.col(f"{m}.middle") + FENCE * spread(m, to)
    least = {m: 1 / F.greatest(F.col(f"{n}.middle"), F.lit(1.0)) for m, n in SHARES.items()}
    # A quantile may lie this far from the value it stands for.
    limits = {m: (F.greatest(fence(m), least[m]) if m in least else fence(m)) * (1 + RELATIVE_ERROR) for m in MEASURES}
    by_fence = sum((F.when(fence(m) > least[m], 1).otherwise(0) for m in SHARES), F.lit(2))
    least_chars = fence("chars_per_word", "lower") * (1 - RELATIVE_ERROR)
    found = wide.select("lang", "source", *(x.alias(f"{m}_limit") for m, x in limits.items()), least_chars.alias("chars_per_word_least"), by_fence.alias("by_fence"))
    return common.written(found, "limits")


def within_limits():
    """No measure is beyond its limit by more than the noise of a text of that length."""
    words, lines = (F.greatest(F.col(n), F.lit(1)) for n in ("n_words", "n_lines"))
    counted = lambda m: 1 / words + DEVIATIONS * F.sqrt(F.col(f"{m}_limit") / words)
    own = F.sqrt(F.greatest(F.lit(0.0), F.col("word_squares") / words - F.pow(F.col("chars_per_word"), 2)))
    noise = {"symbols_per_word": counted("symbols_per_word"), "dup_line_share": 1 / lines, "echo_share": counted("echo_share"), "chars_per_word": DEVIATIONS * own / F.sqrt(words)}
    within = F.col("chars_per_word") >= F.col("chars_per_word_least") - noise["chars_per_word"]
    for m in MEASURES:
        within = within & (F.col(m) <= F.col(f"{m}_limit") + noise[m])
    return F.coalesce(within, F.lit(False))


LIMITS = [*(f"{m}_limit" for m in MEASURES), "chars_per_word_least", "by_fence"]


def judge(docs: DataFrame, **cols) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the measures of each row."""
    counted = with_counts(docs, **cols).withColumns(_measures())
    # Counting is the costly step: its result, a hundred bytes a row, is written once and read for both passes.
    counted = common.written(counted, "quality")
    c, t = counted.alias("c"), thresholds(counted).alias("t")
    failed = base_failed()
    # One row for each language and source; the optimizer broadcasts it while it is small.
    joined = c.join(t, F.col("c.lang").eqNullSafe(F.col("t.lang")) & F.col("c.source").eqNullSafe(F.col("t.source")), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & within_limits()).alias("kept"), *MEASURES, *LIMITS,
    )


def filtered(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", source_col="source") -> DataFrame:
    """docs without the rows that are not kept, columns as they were.

    The rows are written once with their counts: those alone are read for the
    sketches, and the texts once more to filter them.  No text is moved while the
    limits' table is small, and none is counted twice.
    """
    common.prepare(docs.sparkSession)
    names = [c.split()[0] for c in COUNTS.split(", ")]

    @F.pandas_udf(COUNTS)
    def counted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counts(t) for t in texts], columns=names)

    rows = docs.select(
        F.struct(*(F.col(f"`{n}`") for n in docs.columns)).alias("row"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"),
        counted(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("c"),
    )
    rows = common.written(rows.select("row", "lang", "source", "c.*"), "counted").withColumns(_measures())
    r, t = rows.alias("r"), thresholds(rows).alias("t")
    joined = r.join(t, F.col("r.lang").eqNullSafe(F.col("t.lang")) & F.col("r.source").eqNullSafe(F.col("t.source")), "left")
    return joined.filter(~base_failed() & within_limits()).select("row.*")


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
