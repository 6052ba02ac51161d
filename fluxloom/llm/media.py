"""ISO media containers: boxes and sample tables, read without decoding payloads.

scan() walks the nested boxes of a container, decodes the sample tables of each
track and returns codec, duration, and the byte ranges of keyframes, of whole
files and of fragmented ones (samples listed in moof boxes).  mux() stores bytes
losslessly as a video track of 8 by 8 pixel, 8-bit grey frames.

Tables are checked against the file's length before they are spread, and boxes
nest to MAX_DEPTH, so a crafted file costs no more than its own size.

Nulls, empties: a null or broken container gives no tracks and a reason in
error; a null text is an empty payload.  Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from fluxloom.llm import common

FRAME, TIMESCALE, FRAME_TICKS, CHUNK_FRAMES, KEY_EVERY = 64, 12_800, 512, 16, 32
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
#: Deeper than any container of the standard nests.
MAX_DEPTH = 32
#: Flags of a sample that no decoding can start at.
NOT_SYNC = 0x10000
#: Identity of the mvhd and tkhd transformation.
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    n = len(body) + 8
    return (struct.pack(">I4s", n, kind) if n < 1 << 32 else struct.pack(">I4sQ", 1, kind, n + 8)) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(payload: bytes) -> bytes:
    """With bytes 0 behind it, up to a positive multiple of a frame."""
    return payload + bytes(FRAME - len(payload) % FRAME if len(payload) % FRAME or not payload else 0)


def mux(payload: bytes) -> bytes:
    """A container with the payload (whole frames) as its only track."""
    n = len(payload) // FRAME
    chunks = -(-n // CHUNK_FRAMES)
    last = n - (chunks - 1) * CHUNK_FRAMES
    ticks = n * FRAME_TICKS
    wide = ticks >= 1 << 32
    stamp = lambda *more: struct.pack(">QQ" if wide else ">II", 0, 0) + b"".join(more)
    long = lambda x: struct.pack(">Q" if wide else ">I", x)
    u32 = lambda *x: struct.pack(f">{len(x)}I", *x)

    def head(offset: int) -> bytes:
        entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
        runs = [(1, CHUNK_FRAMES, 1), (chunks, last, 1)] if chunks > 1 and last != CHUNK_FRAMES else [(1, last if chunks == 1 else CHUNK_FRAMES, 1)]
        at = offset + np.arange(chunks, dtype=np.uint64) * np.uint64(CHUNK_FRAMES * FRAME)
        big = offset + len(payload) >= 1 << 32
        stbl = box(
            b"stbl",
            full(b"stsd", u32(1), entry),
            full(b"stts", u32(1, n, FRAME_TICKS)),
            full(b"stss", u32(-(-n // KEY_EVERY)), np.arange(1, n + 1, KEY_EVERY, dtype=">u4").tobytes()),
            full(b"stsc", u32(len(runs), *(x for r in runs for x in r))),
            full(b"stsz", u32(FRAME, n)),
            full(b"co64" if big else b"stco", u32(chunks), at.astype(">u8" if big else ">u4").tobytes()),
        )
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", u32(1), full(b"url ", flags=1))), stbl)
        v = int(wide)
        mdia = box(
            b"mdia",
            full(b"mdhd", stamp(u32(TIMESCALE), long(ticks), struct.pack(">HH", 0x55C4, 0)), version=v),
            full(b"hdlr", u32(0), b"vide", bytes(12), b"frames\0"),
            minf,
        )
        tkhd = full(b"tkhd", stamp(u32(1, 0), long(ticks), bytes(8), struct.pack(">hhhH", 0, 0, 0, 0), MATRIX, u32(8 << 16, 8 << 16)), version=v, flags=3)
        mvhd = full(b"mvhd", stamp(u32(TIMESCALE), long(ticks), u32(0x10000), struct.pack(">H", 0x100), bytes(10), MATRIX, bytes(24), u32(2)), version=v)
        return box(b"ftyp", b"isom", u32(512), b"isommp41") + box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    wrap = 16 if len(payload) + 8 >= 1 << 32 else 8
    start = len(head(0)) + wrap
    if start + len(payload) >= 1 << 32:  # then head() grows by the wider offsets
        start = len(head(1 << 32)) + wrap
    return head(start) + box(b"mdat", payload)


def walk(data, start: int = 0, end: int | None = None):
    """Every box: path of kinds, start, and start and end of its body."""
    todo: list[tuple[int, int, tuple]] = [(start, len(data) if end is None else end, ())]
    while todo:
        start, end, path = todo.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("a box ends in its header")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            raise ValueError(f"box {kind!r} leaves its parent")
        yield (*path, kind), start, body, stop
        todo.append((stop, end, path))
        if kind in NESTED:
            if len(path) >= MAX_DEPTH:
                raise ValueError("boxes nest too deep")
            todo.append((body, stop, (*path, kind)))


@dataclass
class Track:
    track_id: int = 0
    codec: str = ""
    timescale: int = 0
    ticks: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def seconds(self) -> float:
        return self.ticks / self.timescale if self.timescale else 0.0

    def keyframes(self) -> list[tuple[int, int]]:
        return list(zip(self.offsets[self.keys].tolist(), self.sizes[self.keys].tolist(), strict=True))


def _table(data, at: int, end: int, kind: str, columns: int = 1, n: int | None = None) -> np.ndarray:
    """A table of n big-endian numbers (or counted by what stands before it); kind is its numpy type."""
    if n is None:
        (n,), at = struct.unpack_from(">I", data, at), at + 4
    if at + n * columns * np.dtype(kind).itemsize > end:
        raise ValueError("a table leaves its box")
    t = np.frombuffer(data, kind, n * columns, at)
    if kind == ">u8" and (t > len(data)).any():
        raise ValueError("an offset beyond the end")
    t = t.astype(np.int64)
    return t.reshape(n, columns) if columns > 1 else t


def _sizes(data, kind: bytes, at: int, end: int) -> np.ndarray:
    """Sample sizes of a stsz or stz2 box."""
    if kind == b"stsz":
        size, n = struct.unpack_from(">II", data, at + 4)
        if not size:
            return _table(data, at + 8, end, ">u4")
        if size * n > len(data):  # a stated count that the file can't hold
            raise ValueError("more samples than bytes")
        return np.full(n, size, np.int64)
    bits, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
    if bits in (8, 16):
        return _table(data, at + 12, end, f">u{bits // 8}", 1, n)
    if bits != 4:
        raise ValueError("sizes of no known width")
    pairs = _table(data, at + 12, end, ">u1", 1, -(-n // 2))
    return np.stack([pairs >> 4, pairs & 15], axis=1).reshape(-1)[:n]


def _chunked(sizes: np.ndarray, at: np.ndarray, runs: np.ndarray | None) -> np.ndarray:
    """Offsets of samples from those of chunks and the runs of samples a chunk."""
    n = len(sizes)
    if runs is None or not len(at) or not len(runs):
        raise ValueError("samples without chunks")
    first = runs[:, 0]
    if first[0] != 1 or (np.diff(first) <= 0).any():
        raise ValueError("runs of chunks out of order")
    first = first[first <= len(at)]
    per = np.repeat(runs[: len(first), 1], np.diff([*first, len(at) + 1]))
    upto = np.cumsum(np.minimum(per, n))
    if upto[-1] < n:
        raise ValueError("chunks hold fewer samples than there are")
    chunk = np.searchsorted(upto, np.arange(n), side="right")
    before = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    starts = np.concatenate([[0], np.flatnonzero(np.diff(chunk)) + 1])
    return at[chunk] + before - np.repeat(before[starts], np.diff([*starts, n]))


def _run(data, at: int, end: int, traf: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sizes, offsets, which are keyframes, and ticks of the samples of a trun box."""
    flags, n = struct.unpack_from(">II", data, at)
    at, start = at + 8, traf.get("next", traf["base"])
    if flags & 1:
        start, at = traf["base"] + struct.unpack_from(">i", data, at)[0], at + 4
    first = None
    if flags & 4:
        (first,), at = struct.unpack_from(">I", data, at), at + 4
    wanted = [f for f in (0x100, 0x200, 0x400, 0x800) if flags & f]
    if n > len(data) or not wanted and traf["size"] * n > len(data):
        raise ValueError("more samples than bytes")
    rows = _table(data, at, end, ">u4", len(wanted), n).reshape(n, -1) if wanted else np.zeros((n, 0), np.int64)
    column = lambda f, usual: rows[:, wanted.index(f)] if f in wanted else np.full(n, usual, np.int64)
    sizes, kinds = column(0x200, traf["size"]), column(0x400, traf["flags"]).copy()
    if first is not None and n:
        kinds[0] = first
    offsets = start + np.concatenate([[0], np.cumsum(sizes)])
    if start < 0 or offsets[-1] > len(data):
        raise ValueError("a sample lies beyond the end")
    traf["next"] = int(offsets[-1])
    return sizes, offsets[:-1], kinds & NOT_SYNC == 0, int(column(0x100, traf["duration"]).sum())


def tracks(data: bytes) -> list[Track]:
    """The tracks of a container, by its tables alone."""
    out: list[Track] = []
    tables: list[dict] = []
    usual: dict[int, tuple] = {}  # duration, size, flags of a track's samples in fragments
    runs: list[tuple[int, int, dict]] = []
    moof, traf = 0, None
    for path, start, at, end in walk(data):
        kind = path[-1]
        if kind == b"trak":
            out.append(Track())
            tables.append({})
        elif kind == b"moof":
            moof = start
        elif kind == b"trex":
            track, _, *rest = struct.unpack_from(">5I", data, at + 4)
            usual[track] = tuple(rest)
        elif kind == b"tfhd":
            flags, track = struct.unpack_from(">II", data, at)
            flags, at = flags & 0xFFFFFF, at + 8
            duration, size, kinds = usual.get(track, (0, 0, 0))
            base = moof
            if flags & 1:
                (base,), at = struct.unpack_from(">Q", data, at), at + 8
                if base > len(data):
                    raise ValueError("an offset beyond the end")
            at += 4 * bool(flags & 2)
            if flags & 8:
                (duration,), at = struct.unpack_from(">I", data, at), at + 4
            if flags & 16:
                (size,), at = struct.unpack_from(">I", data, at), at + 4
            if flags & 32:
                (kinds,), at = struct.unpack_from(">I", data, at), at + 4
            traf = {"track": track, "base": base, "duration": duration, "size": size, "flags": kinds}
        elif kind == b"trun" and traf is not None:
            runs.append((at, end, traf))
        elif b"trak" not in path:
            continue
        elif kind == b"tkhd":
            out[-1].track_id = struct.unpack_from(">I", data, at + (20 if data[at] else 12))[0]
        elif kind == b"mdhd":
            out[-1].timescale, out[-1].ticks = struct.unpack_from(">IQ", data, at + 20) if data[at] else struct.unpack_from(">II", data, at + 12)
        elif kind == b"stsd" and struct.unpack_from(">I", data, at + 4)[0]:
            out[-1].codec = data[at + 12 : at + 16].decode("latin-1").rstrip()
        elif kind in (b"stts", b"stsc"):
            tables[-1][kind] = _table(data, at + 4, end, ">u4", 2 if kind == b"stts" else 3)
        elif kind in (b"stco", b"co64"):
            tables[-1][b"stco"] = _table(data, at + 4, end, ">u4" if kind == b"stco" else ">u8")
        elif kind == b"stss":
            tables[-1][kind] = _table(data, at + 4, end, ">u4")
        elif kind in (b"stsz", b"stz2"):
            out[-1].sizes = _sizes(data, kind, at, end)
    for t, held in zip(out, tables, strict=True):
        if not t.ticks and b"stts" in held:
            t.ticks = sum(n * d for n, d in held[b"stts"].tolist())
        n = len(t.sizes)
        if n:
            t.offsets = _chunked(t.sizes, held.get(b"stco", np.zeros(0, np.int64)), held.get(b"stsc"))
            if (t.offsets + t.sizes > len(data)).any():
                raise ValueError("a sample lies beyond the end")
        t.keys = held[b"stss"] - 1 if b"stss" in held else np.arange(n)
        if len(t.keys) and (t.keys.min() < 0 or t.keys.max() >= n):
            raise ValueError("a keyframe that is no sample")
    more: dict[int, list[tuple]] = {t.track_id: [] for t in out}
    for at, end, traf in runs:
        if traf["track"] not in more:
            raise ValueError("a fragment of no track")
        more[traf["track"]].append(_run(data, at, end, traf))
    for t in out:
        if found := more.pop(t.track_id, []):
            sizes, offsets, keys, ticks = zip(*found, strict=True)
            t.keys = np.concatenate([t.keys, len(t.sizes) + np.flatnonzero(np.concatenate(keys))])
            t.sizes, t.offsets, t.ticks = np.concatenate([t.sizes, *sizes]), np.concatenate([t.offsets, *offsets]), t.ticks + sum(ticks)
    if any(t.ticks >= 1 << 63 for t in out):
        raise ValueError("a duration beyond any clock")
    return out


def samples(data: bytes, t: Track) -> bytes:
    """The track's stored bytes in sample order, neighbours read at once."""
    if not len(t.sizes):
        return b""
    ends = t.offsets + t.sizes
    cut = np.flatnonzero(t.offsets[1:] != ends[:-1]) + 1
    return b"".join(data[a:b] for a, b in zip(t.offsets[[0, *cut]].tolist(), ends[[*(cut - 1), len(ends) - 1]].tolist(), strict=True))


TRACKS = "array<struct<track_id:long,codec:string,timescale:long,ticks:long,seconds:double,n_samples:long,keyframes:array<struct<start:long,length:long>>>>"


def scan(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """doc_id, tracks, error of each container."""
    d = media.selectExpr(f"CAST(`{id_col}` AS LONG) AS doc_id", f"CAST(`{media_col}` AS BINARY) AS media")

    def one(data: bytes | None) -> tuple[list, str | None]:
        if data is None:
            return [], "no container"
        try:
            return [
                {"track_id": t.track_id, "codec": t.codec, "timescale": t.timescale, "ticks": t.ticks, "seconds": t.seconds, "n_samples": len(t.sizes), "keyframes": [{"start": a, "length": n} for a, n in t.keyframes()]}
                for t in tracks(bytes(data))
            ], None
        except (ValueError, struct.error, IndexError, OverflowError, MemoryError) as e:
            return [], str(e) or type(e).__name__

    def make():
        def of(b: dict) -> dict:
            rows = [one(x) for x in b["media"]]
            return {"doc_id": b["doc_id"], "tracks": [r[0] for r in rows], "error": [r[1] for r in rows]}

        return of

    return common.by_batch(d, f"doc_id long, tracks {TRACKS}, error string", make)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, media binary: each text's bytes in a container."""
    return common.by_batch(
        common.id_text(docs, id_col, text_col), "doc_id long, media binary",
        lambda: lambda b: {"doc_id": b["doc_id"], "media": [mux(padded(t.encode())) for t in b["text"]]},
    )


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns: store, walk, read back by the tables, and sum up; one pass, no container is moved."""

    def one(text: str) -> tuple:
        raw = text.encode()
        data = mux(padded(raw))
        (t,) = tracks(data)
        back = samples(data, t)
        ranges = ";".join(f"{a}+{n}" for a, n in t.keyframes())
        feature = f"codec={t.codec};ticks={t.ticks};timescale={t.timescale};samples={len(t.sizes)};keyframes={len(t.keys)};ranges_crc32={zlib.crc32(ranges.encode())}"
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-FRAME:]), len(data), hashlib.sha256(data).hexdigest(), feature, t.seconds, len(t.keys), t.offsets[t.keys], t.sizes[t.keys]

    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds", "n_keyframes", "keyframe_starts", "keyframe_lengths")
    kinds = ("long", "long", "string", "long", "long", "string", "string", "double", "long", "array<long>", "array<long>")

    def make():
        def of(b: dict) -> dict:
            rows = [one(t) for t in b["text"]]
            return {"doc_id": b["doc_id"]} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

        return of

    return common.by_batch(common.id_text(docs, id_col, text_col), "doc_id long, " + ", ".join(map(" ".join, zip(names, kinds, strict=True))), make)
