"""ISO media containers as columns: writing, walking boxes, reading sample tables.

A payload is stored as the samples of one track: 64-byte samples of 8-bit PCM ('raw '),
gathered in chunks, every 16th sample a sync sample. Reading walks the nested boxes,
decodes the sample tables (sizes, chunks, offsets, times, sync samples) and the runs of
fragments, and gives codec, duration and the byte ranges of key frames of every track;
media data is sliced by those ranges, never decoded. Boxes of 64-bit size, 64-bit chunk
offsets, compact sizes and tables with a constant sample size are read.

Files come from anywhere: every table is held against the bytes that are there before it is
read, so a cut or altered file gives the tracks that can be read and says what is wrong;
it never ends a job, and nothing is allocated by what a damaged number says.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, lean, materialise

SAMPLE = 64
CHUNK_SAMPLES = 64
SYNC_EVERY = 16
TIMESCALE = 8000
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def pad(text: str | None) -> bytes:
    """A text's UTF-8 bytes, with zeros up to a positive multiple of 64."""
    b = (text or "").encode()
    return b + bytes(max(SAMPLE, -(-len(b) // SAMPLE) * SAMPLE) - len(b))


def write_media(payload: bytes) -> bytes:
    """A file whose only track holds the payload, a positive multiple of 64 bytes."""
    n = len(payload) // SAMPLE
    chunks = -(-n // CHUNK_SAMPLES)
    matrix = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    ftyp = box(b"ftyp", b"qt  ", struct.pack(">I", 0), b"qt  ")
    runs = [(1, CHUNK_SAMPLES)] if n >= CHUNK_SAMPLES else []
    if n % CHUNK_SAMPLES:
        runs.append((chunks, n % CHUNK_SAMPLES))
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    data = 8 if len(payload) + 8 < 1 << 32 else 16

    def moov(offset: int) -> bytes:
        at = offset + np.arange(chunks, dtype=np.int64) * (SAMPLE * CHUNK_SAMPLES)
        offsets = full(b"stco", struct.pack(">I", chunks), at.astype(">u4").tobytes()) if at[-1] < 1 << 32 else full(b"co64", struct.pack(">I", chunks), at.astype(">u8").tobytes())
        sync = np.arange(1, n + 1, SYNC_EVERY)
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, SAMPLE)),
            full(b"stss", struct.pack(">I", len(sync)), sync.astype(">u4").tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", a, k, 1) for a, k in runs)),
            full(b"stsz", struct.pack(">II", SAMPLE, n)),
            offsets,
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n * SAMPLE & 0xFFFFFFFF, 0x55C4, 0)), full(b"hdlr", bytes(4), b"soun", bytes(13)), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n * SAMPLE & 0xFFFFFFFF), bytes(8), struct.pack(">hhhH", 0, 0, 0x100, 0), matrix, bytes(8), flags=7)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, n * SAMPLE & 0xFFFFFFFF, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    offset = len(ftyp) + len(moov(0)) + data
    head = moov(offset)
    if len(head) + len(ftyp) + data != offset:  # offsets need 64 bits
        offset = len(head) + len(ftyp) + data
        head = moov(offset)
    return b"".join([ftyp, head, box(b"mdat", payload)])


class Damaged(ValueError):
    """A file's boxes contradict each other or its length."""


#: Levels of boxes that are followed.
DEPTH = 16


def walk(data: bytes) -> Iterator[tuple[tuple[bytes, ...], int, int, int]]:
    """(path, start, end) of the content of every box, and where its head begins, depth first. A box that is cut off
    ends with what holds it."""
    stack: list[tuple[int, int, tuple[bytes, ...]]] = [(0, len(data), ())]
    while stack:
        start, end, path = stack.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                continue
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head:
            continue
        stop = min(end, start + size)
        yield (*path, kind), start + head, stop, start
        stack.append((stop, end, path))
        if kind in NESTED and len(path) < DEPTH:
            stack.append((start + head, stop, (*path, kind)))


class Box:
    """Reads numbers of one box, never behind its end."""

    def __init__(self, data: bytes, start: int, end: int):
        self.data, self.at, self.end = data, start, end

    def numbers(self, kind: str, count: int) -> np.ndarray:
        size = np.dtype(kind).itemsize * count
        if self.at + size > self.end:
            raise Damaged("a table is cut off")
        self.at += size
        return np.frombuffer(self.data, dtype=kind, count=count, offset=self.at - size).astype(np.int64)

    def one(self, kind: str = ">u4") -> int:
        return int(self.numbers(kind, 1)[0])

    def skip(self, n: int) -> "Box":
        self.at += n
        return self

    def name(self) -> str:
        return bytes(self.numbers("u1", 4).astype(np.uint8)).decode("latin-1")

    def table(self, columns: int = 1, kind: str = ">u4") -> np.ndarray:
        return self.numbers(kind, columns * self.one()).reshape(-1, columns)


def _sizes(boxes: dict[bytes, Box], length: int) -> np.ndarray:
    if b"stsz" in boxes:
        b = boxes[b"stsz"].skip(4)
        constant, n = b.one(), b.one()
        if not constant:
            return b.numbers(">u4", n)
        if constant * n > length:
            raise Damaged("samples are longer than the file")
        return np.full(n, constant, dtype=np.int64)
    b = boxes[b"stz2"].skip(7)
    width, n = b.one("u1"), b.one()
    if width == 4:
        pairs = b.numbers("u1", (n + 1) // 2)
        return np.stack([pairs >> 4, pairs & 15], axis=1).ravel()[:n]
    if width not in (8, 16):
        raise Damaged("unknown width of sizes")
    return b.numbers(">u1" if width == 8 else ">u2", n)


def _ticks(times: np.ndarray) -> int:
    total = sum(a * b for a, b in times.tolist())
    if total >= 1 << 62:
        raise Damaged("durations are out of range")
    return total


def _within(ranges: np.ndarray, length: int) -> np.ndarray:
    if len(ranges) and (ranges.min() < 0 or ranges[:, 1].max() > length):
        raise Damaged("samples lie outside the file")
    return ranges


def _tables(boxes: dict[bytes, Box], length: int) -> tuple[str, int, np.ndarray, np.ndarray]:
    """Codec, duration, samples and key frames (start, end) by a track's sample tables."""
    codec = boxes[b"stsd"].skip(12).name()
    sizes = _sizes(boxes, length)
    n = len(sizes)
    duration = _ticks(boxes[b"stts"].skip(4).table(2)) if b"stts" in boxes else 0
    none = np.zeros((0, 2), dtype=np.int64)
    if not n:
        return codec, duration, none, none
    offsets = boxes[b"co64"].skip(4).table(1, ">i8")[:, 0] if b"co64" in boxes else boxes[b"stco"].skip(4).table()[:, 0]
    runs = boxes[b"stsc"].skip(4).table(3)
    first = np.append(runs[:, 0], len(offsets) + 1)
    if not len(runs) or runs[0, 0] != 1 or (np.diff(first) < 0).any():
        raise Damaged("chunks are out of order")
    # samples of each chunk, no more of them than there are, and their sums
    upto = np.cumsum(np.minimum(np.repeat(runs[:, 1], np.diff(first)), n))
    if not len(upto) or upto[-1] < n:
        raise Damaged("samples without a chunk")
    chunk = np.searchsorted(upto, np.arange(n), side="right")
    before = np.concatenate([[0], np.cumsum(sizes)])
    starts = offsets[chunk] + before[:n] - before[np.where(chunk > 0, upto[chunk - 1], 0)]
    ranges = _within(np.stack([starts, starts + sizes], axis=1), length)
    keys = boxes[b"stss"].skip(4).table()[:, 0] - 1 if b"stss" in boxes else np.arange(n)
    if len(keys) and (keys.min() < 0 or keys.max() >= n):
        raise Damaged("a key frame that is no sample")
    return codec, duration, ranges, ranges[keys]


#: In a sample's flags: it is no key frame.
NOT_SYNC = 0x10000


def _run(b: Box, defaults: dict[str, int], base: int, after: int, length: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Duration, samples and key frames of one run of a fragment. base: what its offset
    counts from; after: the end of the run before."""
    flags, n = b.one() & 0xFFFFFF, b.one()
    start = base + b.one(">i4") if flags & 1 else after
    first = b.one() if flags & 4 else None
    columns = [name for bit, name in ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")) if flags & bit]
    if n > length:
        raise Damaged("more samples than bytes")
    rows = b.numbers(">u4", n * len(columns)).reshape(n, len(columns))
    of = lambda name: rows[:, columns.index(name)] if name in columns else np.full(n, defaults[name], dtype=np.int64)
    sizes, marks = of("size"), of("flags").copy()
    if first is not None and n:
        marks[0] = first
    ends = start + np.cumsum(sizes)
    ranges = _within(np.stack([ends - sizes, ends], axis=1), length)
    return int(of("duration").sum()), ranges, ranges[(marks & NOT_SYNC) == 0]


class Track:
    def __init__(self):
        self.id, self.handler, self.codec, self.timescale, self.duration = None, None, None, None, 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.boxes: dict[bytes, Box] = {}

    def add(self, duration: int, samples: np.ndarray, keyframes: np.ndarray) -> None:
        self.duration += duration
        self.parts.append((samples, keyframes))

    @property
    def samples(self) -> np.ndarray:
        return self._joined(0)

    @property
    def keyframes(self) -> np.ndarray:
        return self._joined(1)

    def _joined(self, k: int) -> np.ndarray:
        """The parts of fragments as one, joined when they are first asked for."""
        if len(self.parts) > 1:
            self.parts = [tuple(np.concatenate(x) for x in zip(*self.parts))]
        return self.parts[0][k] if self.parts else np.zeros((0, 2), dtype=np.int64)


def read_media(data: bytes) -> tuple[list[Track], str | None]:
    """All tracks that have samples, and what is wrong with the file, if anything is."""
    tracks: list[Track] = []
    extends: dict[int, dict[str, int]] = {}
    wrong: list[str] = []
    fragment: dict = {}
    moof = 0

    def versioned(box: Box, short: int, long: int) -> Box:
        return box.skip(long) if box.one("u1") == 1 else box.skip(short)

    def visit(path: tuple[bytes, ...], a: int, b: int, begin: int) -> None:
        nonlocal fragment, moof
        kind, box = path[-1], Box(data, a, b)
        if kind == b"trak":
            tracks.append(Track())
        elif kind == b"moof":
            moof = begin
        elif kind == b"traf":
            fragment = {"base": moof, "after": moof}
        elif kind == b"trex":
            track, _, duration, size, flags = box.skip(4).numbers(">u4", 5).tolist()
            extends[track] = {"duration": duration, "size": size, "flags": flags}
        elif kind == b"tfhd" and path[-2:-1] == (b"traf",):
            flags, track = box.one() & 0xFFFFFF, box.one()
            fragment |= {"track": track, "defaults": dict(extends.get(track, {"duration": 0, "size": 0, "flags": 0}))}
            if flags & 1:
                fragment["base"] = fragment["after"] = box.one(">i8")
            if flags & 2:
                box.skip(4)
            for bit, name in ((8, "duration"), (16, "size"), (32, "flags")):
                if flags & bit:
                    fragment["defaults"][name] = box.one()
        elif kind == b"trun" and path[-2:-1] == (b"traf",):
            if "track" not in fragment:
                raise Damaged("a run without a header")
            track = next((t for t in tracks if t.id == fragment["track"]), None)
            if track is None:
                raise Damaged("a run of an unknown track")
            found = _run(box, fragment["defaults"], fragment["base"], fragment["after"], len(data))
            track.add(*found)
            if len(found[1]):
                fragment["after"] = int(found[1][-1, 1])
        elif tracks and kind == b"tkhd":
            tracks[-1].id = versioned(box, 11, 19).one()
        elif tracks and kind == b"mdhd":
            tracks[-1].timescale = versioned(box, 11, 19).one()
        elif tracks and kind == b"hdlr" and path[-2:-1] == (b"mdia",):
            tracks[-1].handler = box.skip(8).name()
        elif tracks and path[-2:-1] == (b"stbl",):
            tracks[-1].boxes[kind] = box

    def tables(track: Track) -> None:
        held, track.boxes = track.boxes, {}
        if {b"stsd", b"stsc"} <= held.keys() and held.keys() & {b"stsz", b"stz2"} and held.keys() & {b"stco", b"co64"}:
            track.codec, *found = _tables(held, len(data))
            track.add(*found)

    done = 0
    for path, a, b, begin in walk(data):
        try:
            visit(path, a, b, begin)
        except Damaged as e:
            wrong.append(f"{path[-1].decode('latin-1')}: {e}")
        if path[-1] in (b"trak", b"moof", b"mdat") or b == len(data):
            # tables of the tracks whose boxes have all been seen
            last = len(tracks) - (path[-1] == b"trak")
            for track in tracks[done:last]:
                try:
                    tables(track)
                except Damaged as e:
                    wrong.append(f"trak: {e}")
            done = max(done, last)
    for track in tracks[done:]:
        try:
            tables(track)
        except Damaged as e:
            wrong.append(f"trak: {e}")
    return [t for t in tracks if len(t.samples)], "; ".join(wrong)[:1000] or None


def main_track(tracks: list[Track]) -> Track | None:
    """The first video track, else the first."""
    return next((t for t in tracks if t.handler == "vide"), tracks[0] if tracks else None)


def joined(data: bytes, ranges: np.ndarray) -> bytes:
    """The bytes of the ranges; neighbours are taken together."""
    cuts = np.flatnonzero(ranges[1:, 0] != ranges[:-1, 1]) + 1
    first = np.concatenate([[0], cuts])
    last = np.concatenate([cuts, [len(ranges)]]) - 1
    return b"".join(data[a:b] for a, b in zip(ranges[first, 0].tolist(), ranges[last, 1].tolist()))


def store_media(docs: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """docs with a binary column: the text's padded bytes as a file. Null is the empty
    text; equal texts give equal files; very long texts are stored whole; rows that repeat
    stay; a column named as the result is replaced, others pass; an empty table stays empty."""

    @F.pandas_udf("binary")
    @lean
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([write_media(pad(t)) for t in texts], dtype=object)

    return docs.withColumn(out, run(F.col(text)))


TRACK = "id long, handler string, codec string, timescale long, duration long, samples long, keyframes array<struct<start:long,end:long>>"
DIGESTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, error string"


def media_columns(rows: DataFrame, media: str = "media", out: str = "track") -> DataFrame:
    """rows with a struct: id, handler, codec, timescale, duration, samples and keyframes (byte
    ranges) of the main track (the first video track, else the first), the digests
    payload_bytes, payload_sha256 and tail_crc32 of its samples, media_bytes and
    media_sha256 of the file, error, and all tracks in an array.

    Null gives nulls; a file without readable samples gives nulls but for media_bytes and
    media_sha256 and an empty array; error says what is damaged, and is null for a sound
    file. Very long files are read whole, each by itself; rows that repeat give equal
    values; an empty table stays empty; a column named as the result is replaced, others
    pass."""
    names = [x.split()[0] for x in f"{TRACK}, {DIGESTS}".split(", ")]

    def track_row(t: Track) -> tuple:
        return (t.id, t.handler, t.codec, t.timescale, t.duration, len(t.samples), [{"start": a, "end": b} for a, b in t.keyframes.tolist()])

    @F.pandas_udf(f"{TRACK}, {DIGESTS}, tracks array<struct<{TRACK}>>")
    def run(files: pd.Series) -> pd.DataFrame:
        found = []
        for f in files:
            if f is None:
                found.append((None,) * (len(names) + 1))
                continue
            f = bytes(f)
            tracks, error = read_media(f)
            whole = (len(f), hashlib.sha256(f).hexdigest(), error)
            t = main_track(tracks)
            if t is None:
                found.append((None,) * (len(names) - 3) + whole + ([],))
                continue
            payload = joined(f, t.samples)
            each = [dict(zip(names, track_row(x))) for x in tracks]
            found.append((*track_row(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *whole, each))
        return pd.DataFrame(found, columns=[*names, "tracks"], dtype=object)

    return rows.withColumn(out, run(F.col(media)))


def op3_media_columns(spark, sf_dir) -> DataFrame:
    stored = store_media(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "media")
    read = media_columns(materialise(stored, "media", compression="zstd"))
    keys = F.xxhash64(F.to_json("track.keyframes"))
    feature = F.concat_ws(";", F.col("track.codec"), F.concat(F.lit("rate="), F.col("track.timescale")), F.concat(F.lit("duration="), F.col("track.duration")), F.concat(F.lit("samples="), F.col("track.samples")), F.concat(F.lit("keyframes="), F.size("track.keyframes")), F.concat(F.lit("ranges="), F.hex(keys)))
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
    return read.select("doc_id", "n_bytes", *[F.col(f"track.{c}") for c in names], feature.alias("feature"))
