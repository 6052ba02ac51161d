"""Encoders, token counts, packing and the token file against the public libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

from fluxloom.llm import bpe, common, dac, packing, token_counts
from fluxloom.llm import tokenizers_ as tok

ODD = [
    None, "", " ", "a", "hello world " * 50, "x" * 3000, " " * 2500 + "y", "\n" * 40 + "don't 'really' stop" * 30, "ü€😀 " * 300,
    "a b  c\x1cd" * 100, "<|endoftext|> x <|startoftext|>", "日本語 テキスト ٣٤", "\x85a\xa0b\x00c", "Kİ İ ΣΑΣ ς", "▁a ▁ b  ", "trailing ", "  lead",
    "tab\there\r\nthere  two",
]


def texts(seed=3, n=40):
    rnd = random.Random(seed)
    return ODD + ["".join(rnd.choice("ab 'rest\n\t1.é\xa0 ") for _ in range(rnd.randint(1, 700))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    t = texts()
    return [(i, x) for i, x in enumerate(t)] + [(None, "null id text"), (5, t[5]), (4, t[4]), (4, "other text of id 4")]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, ids string, part int")


def key(x):
    return -1 if x is None else x


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tok.vocabulary(name))
    t.encode_special_tokens = True
    return t


def ranked():
    import tiktoken

    with open(tok.vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tok.pattern(), mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (20, 5), (200, 100), (32_768, 512)])
def test_chunks_give_the_librarys_ids(df, rows, chunk, overlap):
    path, lib = tok.vocabulary("byte_bpe_50k.tiktoken"), ranked()
    got = sorted((key(r.doc_id), tuple(r.ids)) for r in bpe.encode(df, path, tok.pattern(), chunk_chars=chunk, overlap_chars=overlap).collect())
    assert got == sorted((key(i), tuple(lib.encode_ordinary(t or ""))) for i, t in rows)


def runs_of(spark, text, chunk, overlap):
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    path, lib = tok.vocabulary("byte_bpe_50k.tiktoken"), ranked()
    got = bpe.stitched(d, path, tok.pattern(), chunk, overlap).orderBy("run").collect()
    assert b"".join(r.ids for r in got) == np.array(lib.encode_ordinary(text), "<u4").tobytes()
    return len(got)


def test_stitches_go_on_after_a_long_run(spark):
    words = "some words of usual length, " * 100
    plain = runs_of(spark, words * 2, 200, 40)
    assert plain == -(-len(words * 2) // 200)
    # A run longer than the overlap glues what it touches, and no more.
    for run in ("x" * 300, "0123456789" * 31, "=" * 90):
        n = runs_of(spark, words + run + " " + words, 200, 40)
        assert plain - 2 <= n <= plain + 3
    # Digits are grouped by threes from where they begin: chunks inside agree with each other, but not with the whole.
    digits = "".join(map(str, range(1500)))
    n = runs_of(spark, words + "a" + digits + " " + words, 201, 60)
    assert n >= 2 * len(words) // 201 - 3


def test_cutting_is_one_pass(spark):
    import time

    def took(n):
        d = spark.createDataFrame([(1, "word " * n)], "doc_id long, text string")
        began = time.time()
        bpe.split_chunks(d, tok.vocabulary("byte_bpe_50k.tiktoken"), tok.pattern(), 4096, 64)
        return time.time() - began

    took(1000)
    assert took(800_000) < 8 * max(1.0, took(200_000))


def test_digests_and_decoding(df, rows, spark):
    path, lib = tok.vocabulary("byte_bpe_50k.tiktoken"), ranked()
    got = sorted((key(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df, path, tok.pattern(), chunk_chars=64, overlap_chars=16).collect())
    want = []
    for i, t in rows:
        ids = lib.encode_ordinary(t or "")
        want.append((key(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(bpe.encode(df.filter("doc_id = 8"), path, tok.pattern()), path, tok.pattern()).collect()}
    assert back == {8: rows[8][1].encode()}
    assert bpe.digests(df.limit(0), path, tok.pattern()).count() == 0


def test_heap_merges_as_the_library():
    lib, ranks, rnd = ranked(), tok.read_ranks(tok.vocabulary("byte_bpe_50k.tiktoken")), random.Random(1)
    for n in (1, 2, 3, 10, 200, 1500):
        for letters in ("a", "ab", "then "):
            piece = "".join(rnd.choice(letters) for _ in range(n)).replace(" ", "e").encode()
            assert tok.merge_by_heap(piece, ranks) == lib._core_bpe.encode_single_piece(piece)


@pytest.mark.parametrize("name,make", [("word_bpe_49k.json", tok.word_bpe_json), ("byte_bpe_50k.json", tok.byte_bpe_json)])
def test_json_encoders(name, make):
    lib, enc = library(name), make(tok.vocabulary(name))
    t = [x or "" for x in texts(9)]
    assert enc.encode_all(t) == [np.array(lib.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in t]


LETTERS = [chr(c) for c in range(0x250)]


def latin(seed=5, n=1500):
    rnd = random.Random(seed)
    pairs = [a + b for a in LETTERS for b in ("", "a", "Z", "1", "'s", "!", " x")] + [b + a for a in LETTERS for b in ("a", "9", " ", "-")]
    return pairs + ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(1, 30))) for _ in range(n)] + ["ƏMƏK Əli ve", "Ɓaɓa Ɗan ȺⱥȾⱦ"]


def test_latin_letters_give_the_librarys_tokens():
    import sentencepiece

    for name, make in (("word_bpe_49k.json", tok.word_bpe_json), ("byte_bpe_50k.json", tok.byte_bpe_json)):
        lib, t = library(name), latin()
        assert make(tok.vocabulary(name)).encode_all(t) == [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch(t, add_special_tokens=False)]
    path = tok.vocabulary("piece_bpe_32k.model")
    lib, c = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.PieceCounter(path)
    assert [c.count(t, {}) for t in latin()] == [len(lib.encode(t)) for t in latin()]


def test_summaries_are_merged_level_by_level(spark):
    docs = spark.range(0, 4000, 1, 70).selectExpr("id doc_id", "concat('every word', CAST(id % 7 AS STRING), ' every ', CAST(id AS STRING)) text")
    got = token_counts.frequent(docs, 9)
    assert got == ["every", *(f"word{i}" for i in range(7))]  # words that a task sees once are in no summary
    assert token_counts.frequent(docs, 1) == ["every"]
    assert token_counts.frequent(docs.limit(0)) == []


def test_token_counts(df, rows):
    import sentencepiece

    path = tok.vocabulary("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    for entries in (5, 1000):
        got = sorted((key(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, path, limit=100, entries=entries).collect())
        assert got == sorted((key(i), len((t or "").encode()), n := len(lib.encode(t or "")), n > 100) for i, t in rows)
    assert token_counts.count_tokens(df.limit(0), path).count() == 0


def test_closest_is_the_best_multiset():
    rnd = random.Random(2)
    for _ in range(200):
        lengths = {rnd.randint(1, 40): rnd.randint(1, 4) for _ in range(rnd.randint(1, 6))}
        room = rnd.randint(1, 120)
        best = {0}
        for n, k in lengths.items():
            best = {s + n * j for s in best for j in range(k + 1) if s + n * j <= room}
        got = packing.closest(lengths, room)
        assert all(k <= lengths[n] for n, k in got.items()) and sum(n * k for n, k in got.items()) == max(best)


@pytest.mark.parametrize("size,window", [(4096, 2_000_000), (64, 300)])
def test_packing_holds_every_id_once(df, rows, size, window):
    path, lib = tok.vocabulary("word_bpe_49k.json"), library("word_bpe_49k.json")
    got = packing.pack(df, path, size=size, window_tokens=window, with_ids=True).collect()
    want = sorted((key(i), tuple(lib.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows)
    by_doc, by_sequence = {}, {}
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        by_doc.setdefault((key(r.doc_id), r.doc_tokens), []).append((r.start, tuple(r.ids)))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(x for _, p in by_doc.items() for _, ids in p for x in ids) == sorted(x for _, ids in want for x in ids)
    single = {k: v for k, v in by_doc.items() if k[0] not in (4, 5)}
    assert sorted((k[0], sum((i for _, i in sorted(v)), ())) for k, v in single.items()) == [w for w in want if w[0] not in (4, 5)]
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == size or at & (at - 1) == 0


def test_shards_give_every_id():
    rnd = np.random.default_rng(4)
    for n, top in ((0, 9), (1, 300), (5000, 50_257), (3000, 200), (2000, 1 << 30)):
        ids = rnd.integers(0, top, n, dtype=np.uint32)
        s = dac.Shard(dac.encode(ids))
        assert len(s) == n and s.range(0, n).tolist() == ids.tolist()
        for i in rnd.integers(0, n, 50) if n else ():
            assert s[int(i)] == ids[i]
            assert s.range(int(i), min(n, int(i) + 700)).tolist() == ids[i : i + 700].tolist()


def test_token_file(df, rows, spark):
    path, lib = tok.vocabulary("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    got = dac.digests(df, path, shard_tokens=500).orderBy("start").collect()
    assert [key(r.doc_id) for r in got] == sorted(key(i) for i, _ in rows)
    at, want = 0, {}
    for i, t in rows:
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.setdefault(key(i), []).append((len(ids), zlib.crc32(ids.tobytes())))
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in want[key(r.doc_id)]
        at += r.n_tokens
    assert dac.digests(df.limit(0), path).count() == 0
    # Rows that are equal in id and text fill several ranges.
    same = spark.createDataFrame([(7, "one text")] * 300 + [(9, "another")] * 5 + [(None, "x")], "doc_id long, text string")
    got = dac.digests(same, path, shard_tokens=20).orderBy("start").collect()
    n = len(lib.encode("one text", add_special_tokens=False).ids) + 1
    assert [r.doc_id for r in got] == [None] + [7] * 300 + [9] * 5 and got[300].start == got[0].n_tokens + 299 * n


def test_shared_folders_are_the_clusters(spark):
    assert common.folder(spark, "x") != common.folder(spark, "x")


def test_ranges_follow_the_sizes_of_texts(spark):
    """A tenth of the documents holds most of the text: ranges are within 2x in tokens, and as many as the text needs."""
    from pyspark.sql import functions as F

    rnd = random.Random(12)
    rows = [(i, " ".join(rnd.choice(["the", "of", "reaction", "species"]) for _ in range(400 if i < 400 else 10))) for i in range(4000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_hash", F.xxhash64("text"))
    for least, range_bytes, some in ((8, dac.RANGE_BYTES, 8), (4, 40_000, 20)):
        bounds = dac.ranges(d, least, range_bytes, 200)
        assert some <= len(bounds) + 1 <= 3 * some and bounds == sorted(bounds)
        sizes = np.zeros(len(bounds) + 1)
        for i, t in rows:
            sizes[sum(b[:2] < (True, i) for b in bounds)] += len(t)
        assert sizes.max() < 2 * sizes.mean() and sizes.min() > sizes.mean() / 2
    # Rows that are all the same fill every range.
    same = spark.createDataFrame([(7, "one text")] * 300, "doc_id long, text string").withColumn("text_hash", F.xxhash64("text"))
    assert len(dac.ranges(same, 6)) == 5 and len(set(dac.ranges(same, 6))) == 1
    assert dac.ranges(d.limit(0), 4) == []


def test_more_ranges_than_partitions_are_written(df, rows, spark, tmp_path):
    path = tok.vocabulary("byte_bpe_50k.json")
    dac.write(df, str(tmp_path / "few"), path)
    dac.write(df, str(tmp_path / "many"), path, range_bytes=5000)
    few, many = (dac.read(spark, str(tmp_path / x)) for x in ("few", "many"))
    assert few.select("part").distinct().count() <= 4 < many.select("part").distinct().count()
    ids = lambda d: [(x, y) for r in d.orderBy("start").collect() for x, y in zip(r.doc_ids, r.lengths, strict=True)]
    assert sorted(ids(few), key=str) == sorted(ids(many), key=str) and [key(x) for x, _ in ids(many)] == sorted(key(i) for i, _ in rows)

