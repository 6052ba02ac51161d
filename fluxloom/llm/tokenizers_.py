"""Loading of public vocabularies and fast, exact encoders over them.

Encoders that cache do so by units, in the worker.  A unit is a stretch of text
between two places that no token of that tokenizer can cross, so joining the
units' tokens gives exactly the library's tokens of the whole text.
"""

from __future__ import annotations

import base64
import heapq
import re
import sys
from array import array
from functools import cached_property, lru_cache

from fluxloom.llm import common  # noqa: F401  (thread settings before the libraries load)

#: Entries after which a worker's unit cache starts anew.
CACHE_ENTRIES = 400_000
#: Longest unit that is cached, in characters.
CACHE_UNIT = 64
#: Pre-tokens over this many bytes are merged by our own heap, whose time is n log n.
LONG_PIECE = 1024


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_by_heap(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merges of one pre-token: lowest rank first, leftmost among equals."""
    n = len(piece)
    if piece in ranks:
        return [ranks[piece]]
    nxt, prev, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(ranks[p], i, i + 2) for i in range(n - 1) if (p := piece[i : i + 2]) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        if not alive[i] or (j := nxt[i]) >= n or end[j] != e:
            continue
        alive[j], end[i], nxt[i] = False, e, nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
            if (p := piece[i : end[nxt[i]]]) in ranks:
                heapq.heappush(heap, (ranks[p], i, end[nxt[i]]))
        if prev[i] >= 0 and (p := piece[prev[i] : e]) in ranks:
            heapq.heappush(heap, (ranks[p], prev[i], e))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = nxt[i]
    return out


_SPACE, _OTHER, _HALF = re.compile(r"\s").search, re.compile(r"\S").search, LONG_PIECE // 2


def long_run(text: str) -> bool:
    """True if a run of LONG_PIECE characters, white space or not, may be there: it would fill some block of half its length."""
    return any(not _SPACE(text, i, i + _HALF) or not _OTHER(text, i, i + _HALF) for i in range(0, len(text) - _HALF + 1, _HALF))


class ByteBpe:
    """Ranks and a splitting pattern: encode by the public library, decode by joining raw bytes."""

    def __init__(self, path: str, pat: str):
        import regex
        import tiktoken

        self.ranks = read_ranks(path)
        self.words = regex.compile(pat)
        self.lib = tiktoken.Encoding("own", pat_str=pat, mergeable_ranks=self.ranks, special_tokens={})
        self.table = [b""] * (max(self.ranks.values()) + 1)
        for b, i in self.ranks.items():
            self.table[i] = b

    def encode(self, text: str) -> list[int]:
        """Each pre-token by itself, no special tokens."""
        if not long_run(text):
            return self.lib.encode_ordinary(text)
        out: list[int] = []
        for m in self.words.finditer(text):
            piece = m.group().encode("utf-8", "replace")
            out += merge_by_heap(piece, self.ranks) if len(piece) > LONG_PIECE else self.lib.encode_ordinary(m.group())
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


@lru_cache(maxsize=2)
def byte_bpe(path: str, pat: str) -> ByteBpe:
    return ByteBpe(path, pat)


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit bytes."""
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


class WordEncoder:
    """BPE with word ends over cached pre-tokens; ids come as little-endian unsigned 32-bit bytes.

    Texts of Latin letters need no normalization but lower case.  They are split
    here by the file's own pattern, and the tokenizers library merges the
    pre-tokens that the cache lacks, many at once: the last token of each has the
    sign of a word's end.  Any other text takes the library whole.
    """

    #: Beyond the Latin blocks, or white space to Python's re alone.
    OTHER = re.compile("[\x1c-\x1f\u0250-\U0010ffff]")
    END = "</w>"

    def __init__(self, path: str):
        import numpy as np
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.merges = Tokenizer(self.lib.model)  # the model alone
        self.merges.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        latin = "".join(map(chr, range(0x250)))
        letters, numbers = ("".join(map(re.escape, regex.findall(c, latin))) for c in (r"\p{L}", r"\p{N}"))
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\s{letters}{numbers}]+").findall
        self.letters = {b: a for a, b in byte_letters().items() if b != 0x20}
        vocab = self.lib.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(self.END)]] = True
        self.cache: dict[str, bytes] = {}

    def _missing(self, pieces: list[str]) -> list[bytes]:
        import numpy as np

        out: list[bytes] = []
        for i in range(0, len(pieces), 8192):
            text = " ".join(pieces[i : i + 8192]).encode().decode("latin-1").translate(self.letters)
            (e,) = self.merges.encode_batch_fast([text], add_special_tokens=False)
            ids = np.asarray(e.ids, "<u4")
            ends, data = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist(), ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        if len(out) != len(pieces):
            raise ValueError("a pre-token without a word's end")
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        # Some capitals of these blocks have their small letter beyond them, so the test comes after the change.
        lower = [t.lower() for t in texts]
        other = [i for i, t in enumerate(lower) if self.OTHER.search(t) or self.OTHER.search(texts[i])]
        whole = dict(zip(other, self.lib.encode_batch_fast([texts[i] for i in other], add_special_tokens=False), strict=True))
        cache, pieces = self.cache, [self.split(t) if i not in whole else [] for i, t in enumerate(lower)]
        missed = set().union(*pieces).difference(cache)
        if len(cache) + len(missed) > CACHE_ENTRIES:
            cache.clear()
            missed = set().union(*pieces)
        if missed:
            new = list(missed)
            cache.update(zip(new, self._missing(new), strict=True))
        out = [b"".join(map(cache.__getitem__, p)) for p in pieces]
        for i, e in whole.items():
            out[i] = packed(e.ids)
        for p in missed:
            if len(p) > CACHE_UNIT:
                del cache[p]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(maxsize=1)
def word_bpe_json(path: str) -> WordEncoder:
    """BPE with word ends."""
    return WordEncoder(path)


class ByteBpeJson:
    """Byte-level BPE of a tokenizers file; ids come as little-endian unsigned 32-bit bytes.

    The file's own vocabulary and pattern run through the faster public library
    where every character's class is the same in both (ASCII and the Latin
    blocks); any other text, and one with a very long run, takes the tokenizers
    library whole.
    """

    OTHER = re.compile("[^\x00-\u024f]")

    def __init__(self, path: str):
        import json

        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, special = file["model"]["vocab"], {t["id"] for t in file["added_tokens"]}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in file["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("the order of ids is not that of merges")
        byte_of = byte_letters()
        ranks = {bytes(map(byte_of.__getitem__, w)): i for w, i in vocab.items() if i not in special}
        self.fast = tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def lib(self):
        """The tokenizers library, loaded when a text needs it."""
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(self.path)
        t.encode_special_tokens = True
        return t

    def encode(self, text: str) -> bytes:
        if self.OTHER.search(text) or long_run(text):
            return packed(self.lib.encode(text, add_special_tokens=False).ids)
        return packed(self.fast.encode_ordinary(text))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return list(map(self.encode, texts))


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, by their public rule."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=1)
def byte_bpe_json(path: str) -> ByteBpeJson:
    return ByteBpeJson(path)
