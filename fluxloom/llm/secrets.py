"""Secret scans: fixed patterns, and assignment-aware lexing.

The lexer reads source and configuration syntax (name = "v", name: v, "name":
"v", name => 'v', name := v, <name>v</name>, export NAME=v) into names and
values.  A value is a sum of terms: quoted literals, bare words, and names whose
value is already known, so constants are propagated through later assignments
and concatenations.  A target name is split into its words, and these and the
value's form give a score; a value at or over the threshold marks each literal
it is made of, where that literal stands.  Names and the blanks around a sign
have any length.  A value is held as what its score needs (length, ends, counts
of its characters) and as the two it was joined from, never written out: names
that double each other's values cost no more than others, as counts beyond
EXACT are kept as shares with an exponent.  Characters beyond ASCII count as one
kind.

Nulls, empties: a null text is an empty text, without spans.  Repeated rows give
repeated results.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
import string
import sys
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.llm import common

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Finds the same runs as HEX does, of at least the kept length.
HEX_KEPT = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS = 12, 18

# Words of target names that point to a secret, and those that point away from one.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "signature": 0.5, "privatekey": 1.0,
    "accesskey": 1.0, "secretkey": 1.0, "encryptionkey": 1.0, "authkey": 1.0, "clientsecret": 1.0,
}
HARMLESS = {
    "file": 0.6, "path": 0.6, "url": 0.5, "uri": 0.5, "name": 0.5, "field": 0.6, "label": 0.6, "hint": 0.6, "policy": 0.6,
    "count": 0.7, "length": 0.7, "size": 0.7, "max": 0.6, "min": 0.6, "type": 0.5, "expires": 0.6, "ttl": 0.7, "public": 0.6,
}
#: Beginnings and whole values that stand for a secret to be filled in.
_TO_FILL = re.compile(r"(?i)\$\{|\{\{|changeme|example|your[_-]|todo|placeholder|redacted")
_NO_VALUE = re.compile(r"(?i)none|null|true|false|undefined")

MIN_LITERAL, SCORE = 8, 0.8
#: Lengths up to which counts of characters are exact.
EXACT = 2.0**53

_SIGN = re.compile(r":=|=>|==?|:|<([A-Za-z_][A-Za-z0-9_.\-]*+)>(?=[^<\s])")
_BLANKS = re.compile(r"""[ \t]*+(?=["'A-Za-z0-9_+/$])""")
_NAME_CHARS = ".-_" + string.ascii_letters + string.digits
_NAME = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z_].*", re.S)
_TERM = re.compile(r""""((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|([A-Za-z_][A-Za-z0-9_.]*)(?=[\s"'<>,;(){}\[\]+&]|$)|([^\s"'<>,;(){}\[\]]+)""")
_PLUS = re.compile(r"[ \t]*(?:\+|\.\.|&)[ \t]*(?=[\"'A-Za-z_])")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> float:
    """How strongly a target name points to a secret, 0 to 1."""
    words = [w.lower() for w in _WORDS.findall(name)]
    pairs = ["".join(words[i : i + 2]) for i in range(len(words) - 1)]
    plus = max((SENSITIVE.get(w, 0.0) for w in words + pairs), default=0.0)
    return max(0.0, plus - max((HARMLESS.get(w, 0.0) for w in words), default=0.0))


@dataclass(frozen=True, eq=False, slots=True)
class Value:
    """What is known of a value: its length, first and last characters, counts of characters, and where its literals stand.

    Length and counts are to be multiplied by 2^exponent; values of the same
    characters share the string that names them.
    """

    n: float
    head: str
    tail: str
    chars: str
    counts: array
    space: bool
    url: bool
    spans: tuple[tuple[int, int], ...] = ()
    parts: tuple[Value, ...] = ()
    exponent: int = 0

    @classmethod
    def of(cls, text: str, *spans: tuple[int, int]) -> Value:
        counts = Counter(c if c < "\x80" else "\x80" for c in text)
        chars = sys.intern("".join(sorted(counts)))
        return cls(len(text), text[:16], text[-2:], chars, array("d", (counts[c] for c in chars)), bool(re.search(r"\s", text)), "://" in text, spans)

    def __add__(self, other: Value) -> Value:
        exponent = max(self.exponent, other.exponent)
        a, b = (2.0 ** max(-2000, v.exponent - exponent) if v.exponent < exponent else 1.0 for v in (self, other))
        n, chars = a * self.n + b * other.n, self.chars
        if chars == other.chars:
            counts = array("d", (a * x + b * y for x, y in zip(self.counts, other.counts, strict=True)))
        else:
            both = dict.fromkeys(sorted({*chars, *other.chars}), 0.0)
            for v, f in ((self, a), (other, b)):
                for c, k in zip(v.chars, v.counts, strict=True):
                    both[c] += f * k
            chars, counts = sys.intern("".join(both)), array("d", both.values())
        if n > EXACT:
            n, counts, exponent = n / EXACT, array("d", (k / EXACT for k in counts)), exponent + 53
        return Value(
            n, self.head if self.exponent or self.n >= 16 else (self.head + other.head)[:16], (self.tail + other.tail)[-2:], chars, counts,
            self.space or other.space, self.url or other.url or "://" in self.tail + other.head[:2], (), (self, other), exponent,
        )

    def places(self, seen: set[int]) -> Iterator[tuple[int, int]]:
        """Spans of all literals below that are not below a value seen before."""
        todo = [self]
        while todo:
            v = todo.pop()
            if id(v) not in seen:
                seen.add(id(v))
                yield from v.spans
                todo += v.parts

    def score(self) -> float:
        """How much it looks like a secret, 0 to 1: length, kinds of characters, entropy."""
        if self.exponent == 0 and self.n < MIN_LITERAL or self.space or self.url or self._stands_for_another():
            return 0.0
        entropy = -sum(k / self.n * math.log2(k / self.n) for k in self.counts if k > 0)
        kinds = {"a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "-" for c in self.chars}
        return min(1.0, 0.35 + 0.15 * len(kinds) + 0.1 * max(0.0, entropy - 2.5))

    def _stands_for_another(self) -> bool:
        ends = self.head[0] + self.tail[-1]
        return bool(
            _TO_FILL.match(self.head) or self.exponent == 0 and self.n <= 16 and _NO_VALUE.fullmatch(self.head) or ends in ("<>", "%%") or self.chars in ("x", "X", "Xx", "*", ".")
        )


def value_score(value: str) -> float:
    return Value.of(value).score()


def _targets(text: str) -> Iterator[tuple[str, int, bool]]:
    """Name, start of the value, and whether that may be a bare word, of every assignment in order.

    Signs are found first; names and blanks before and after them have any
    length.  Neither holds a sign, so each stretch of text is looked at once.
    """
    before = 0
    for m in _SIGN.finditer(text):
        if m[1]:
            yield m[1], m.end(), False
        elif v := _BLANKS.match(text, m.end()):
            left = text[before : m.start()].rstrip(" \t")
            left = left[:-1] if left.endswith(('"', "'")) else left
            if name := _NAME.search(left[len(left.rstrip(_NAME_CHARS)) :]):
                yield name[0], v.end(), text[v.end() - 1] in "=: \t"
        before = m.end()


def _constants(text: str) -> Iterator[tuple[str, Value]]:
    """Every assignment in order: target and value."""
    known: dict[str, Value] = {}
    for name, at, bare in _targets(text):
        value, whole = None, True
        while t := _TERM.match(text, at):
            more = None
            if t.lastindex in (1, 2, 4):
                k = t.lastindex
                end = t.end(k) - (len(t[k]) - len(t[k].rstrip(".:"))) if k == 4 else t.end(k)
                more = Value.of(text[t.start(k) : end], (t.start(k), end))
            elif t[3] in known:
                more = known[t[3]]
            elif bare and value is None and not _PLUS.match(text, t.end()):
                more = Value.of(t[3], t.span(3))  # a bare word, as in configuration files
            else:
                whole = False
            if more is not None:
                value = more if value is None else value + more
            at = t.end()
            if not (p := _PLUS.match(text, at)):
                break
            at = p.end()
        if whole and value is not None:
            known[name] = value
            yield name, value


def literals(text: str) -> list[tuple[int, int]]:
    """Places of literals that reach a sensitive name."""
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    found, seen, held = set(), set(), []
    for name, value in _constants(text):
        if (s := name_score(name)) and s * value.score() >= SCORE * 0.6 and s >= 0.5:
            held.append(value)  # alive, so that no other value takes its place in seen
            found.update(value.places(seen))
    return sorted(s for s in found if s[1] > s[0])


def spans(text: str) -> list[tuple[str, int, int, int, int]]:
    """kind, start, end, and start and end of the secret itself, by start and then kind as listed."""
    out = [("assign", *m.span(), *m.span(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [("access", *m.span(), *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    out += [("hex", *m.span(), *m.span()) for m in HEX_KEPT.finditer(text)]
    out += [("literal", *s, *s) for s in literals(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def redacted(text: str, sign: str = "[SECRET]") -> str:
    """The text with every secret replaced; overlapping ones count as one."""
    out, at, end = [], 0, -1
    for a, b in sorted((s[3], s[4]) for s in spans(text)):
        if a > end:
            out += [text[at:a], sign]
            end = b
        end = at = max(end, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct> of each row."""
    names = ("kind", "start", "end", "secret_start", "secret_end")

    def make():
        return lambda b: {"doc_id": b["doc_id"], "spans": [[dict(zip(names, s, strict=True)) for s in spans(t)] for t in b["text"]]}

    kind = "array<struct<kind:string,start:long,end:long,secret_start:long,secret_end:long>>"
    return common.by_batch(common.id_text(docs, id_col, text_col), f"doc_id long, spans {kind}", make)


def digests(docs: DataFrame, **cols) -> DataFrame:
    """The contract's columns, from scan()'s spans."""
    s = scan(docs, **cols)
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"] != "literal")
    return s.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), n("literal"))


def redact(docs: DataFrame, text_col: str = "text", sign: str = "[SECRET]") -> DataFrame:
    """docs with every secret in the text column replaced; a null text stays null."""
    common.prepare(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(s):
        return s.map(lambda t: None if t is None else redacted(t, sign))

    return docs.withColumn(text_col, clean(F.col(text_col)))

