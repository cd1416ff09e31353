"""Media columns: ISO base media containers, read by walking their boxes and sample tables.

`probe` reads only boxes and tables, those of movie fragments too; no payload is decoded. `mux` stores bytes as 8-bit mono samples.
Defined results: empty or null input has no tracks and status 'empty'; a box that overruns its parent or
a table that points outside the file gives status 'broken' with what was read before; unknown boxes are skipped; a fragment of an unknown track is
'broken'. Rows with null or repeated ids are read like any other, equal bytes give equal values; a very long text is one container; an empty
table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .common import documents, map_rows

#: Boxes that hold boxes (fixed values of the format).
PARENTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
#: Bits of a track fragment's and a run's flags (fixed values of the format).
BASE_OFFSET, DESCRIPTION, DURATION, SIZE, FLAGS = 0x1, 0x2, 0x8, 0x10, 0x20
RUN_OFFSET, RUN_FIRST_FLAGS, RUN_DURATION, RUN_SIZE, RUN_FLAGS, RUN_SHIFT = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
NOT_SYNC = 0x10000
UNIT, RATE, KEY_EVERY = 576, 8000, 16


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 2**32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def mux(payload: bytes, unit: int = UNIT, rate: int = RATE, key_every: int = KEY_EVERY) -> bytes:
    """A file with one sound track: each sample holds `unit` bytes of 8-bit audio, each `key_every`-th is a sync sample."""
    n = len(payload) // unit
    if n * unit != len(payload):
        raise ValueError(f"the payload must be a multiple of {unit} bytes")
    start = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, rate << 16))
    keys = range(1, n + 1, key_every)

    def moov(offset: int) -> bytes:
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, unit)),
            full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", struct.pack(">IIII", 1, 1, max(n, 1), 1)),
            full(b"stsz", struct.pack(">II", unit, n)),
            full(b"co64", struct.pack(">IQ", 1, offset)),
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"smhd", bytes(4)), dinf, stbl)
        hdlr = full(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0")
        mdhd = full(b"mdhd", struct.pack(">QQIQHH", 0, 0, rate, n * unit, 0x55C4, 0), version=1)
        tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, n * unit), bytes(8), struct.pack(">hhhH", 0, 0, 256, 0), matrix, bytes(8), version=1, flags=7)
        mvhd = full(b"mvhd", struct.pack(">QQIQIH", 0, 0, rate, n * unit, 0x10000, 256), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    head = len(start) + len(moov(0))
    return start + moov(head + 8 if len(payload) + 8 < 2**32 else head + 16) + box(b"mdat", payload)


@dataclass
class Track:
    number: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: list[int] = field(default_factory=list)
    deltas: list[tuple[int, int]] = field(default_factory=list)
    chunk_runs: list[tuple[int, int]] = field(default_factory=list)
    chunks: list[int] = field(default_factory=list)
    sync: list[int] | None = None
    ranges: list[tuple[int, int]] = field(default_factory=list)
    #: Duration, size and flags of a sample of a fragment that doesn't give them, and what fragments hold: (begin, end, duration, sync).
    usual: tuple[int, int, int] = (0, 0, 0)
    pieces: list[tuple[int, int, int, bool]] = field(default_factory=list)

    @property
    def samples(self) -> list[tuple[int, int]]:
        """Byte ranges of all samples, those of fragments last."""
        return self.ranges + [(a, b) for a, b, _, _ in self.pieces]

    @property
    def keys(self) -> list[tuple[int, int]]:
        """Byte ranges of the sync samples; without a sync table every sample is one."""
        n = len(self.ranges)
        own = self.ranges if self.sync is None else [self.ranges[k - 1] for k in self.sync if 1 <= k <= n]
        return own + [(a, b) for a, b, _, sync in self.pieces if sync]

    @property
    def seconds(self) -> float | None:
        """The header's duration and that of the fragments; null without a time scale."""
        return (self.duration + sum(d for *_, d, _ in self.pieces)) / self.timescale if self.timescale else None


def boxes(data: bytes, at: int, end: int):
    """(kind, start, end of the body) of each box; raises ValueError where one overruns."""
    while at < end:
        if at + 8 > end:
            raise ValueError("a box header overruns")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            raise ValueError(f"box {kind!r} overruns")
        yield kind, body, at + size
        at += size


def _table(track: Track, data: bytes, kind: bytes, at: int, end: int) -> None:
    version = data[at]
    if kind == b"mdhd":
        track.timescale, track.duration = struct.unpack_from(">IQ" if version else ">II", data, at + (20 if version else 12))
    elif kind == b"tkhd":
        track.number = struct.unpack_from(">I", data, at + (20 if version else 12))[0]
    elif kind == b"hdlr":
        track.handler = data[at + 8 : at + 12].decode("latin-1")
    elif kind == b"stsd" and struct.unpack_from(">I", data, at + 4)[0]:
        track.codec = data[at + 12 : at + 16].decode("latin-1")
    elif kind == b"stsz":
        size, n = struct.unpack_from(">II", data, at + 4)
        if not size and at + 12 + 4 * n > end or n > len(data):
            raise ValueError("stsz overruns")
        track.sizes = [size] * n if size else list(struct.unpack_from(f">{n}I", data, at + 12))
    elif kind == b"stz2":
        bits, n = struct.unpack_from(">BI", data, at + 7)
        raw = data[at + 12 : end]
        if bits * n > 8 * len(raw):
            raise ValueError("stz2 overruns")
        track.sizes = [x for b in raw for x in (b >> 4, b & 15)][:n] if bits == 4 else list(struct.unpack_from(f">{n}{'B' if bits == 8 else 'H'}", raw))
    elif kind in (b"stts", b"stsc", b"stss", b"stco", b"co64"):
        n, width = struct.unpack_from(">I", data, at + 4)[0], {b"stts": 2, b"stsc": 3}.get(kind, 1)
        code = "Q" if kind == b"co64" else "I"
        if at + 8 + n * width * (8 if code == "Q" else 4) > end:
            raise ValueError(f"{kind!r} overruns")
        flat = struct.unpack_from(f">{n * width}{code}", data, at + 8)
        if kind == b"stts":
            track.deltas = list(zip(flat[::2], flat[1::2], strict=True))
        elif kind == b"stsc":
            track.chunk_runs = list(zip(flat[::3], flat[1::3], strict=True))
        elif kind == b"stss":
            track.sync = list(flat)
        else:
            track.chunks = list(flat)


@dataclass
class Fragment:
    """Where the samples of a track fragment go on, and what they have by default."""

    track: Track
    base: int
    usual: tuple[int, int, int]


def _fragment(data: bytes, at: int, end: int, moof: int, tracks: list[Track]) -> Fragment:
    """A track fragment's header; without a base of its own, places count from the movie fragment."""
    flags, number = struct.unpack_from(">II", data, at)
    flags, at = flags & 0xFFFFFF, at + 8
    track = next((t for t in tracks if t.number == number), None)
    if track is None:
        raise ValueError("a fragment of an unknown track")
    base, usual = moof, list(track.usual)
    if flags & BASE_OFFSET:
        base, at = struct.unpack_from(">Q", data, at)[0], at + 8
    at += 4 if flags & DESCRIPTION else 0
    for k, bit in enumerate((DURATION, SIZE, FLAGS)):
        if flags & bit:
            usual[k], at = struct.unpack_from(">I", data, at)[0], at + 4
    return Fragment(track, base, tuple(usual))


def _run(data: bytes, at: int, end: int, fragment: Fragment, following: int | None) -> int:
    """Adds the samples of one run; returns where the next run begins unless it says so itself."""
    flags, n = struct.unpack_from(">II", data, at)
    flags, at = flags & 0xFFFFFF, at + 8
    place = fragment.base if following is None else following
    if flags & RUN_OFFSET:
        place, at = fragment.base + struct.unpack_from(">i", data, at)[0], at + 4
    first = None
    if flags & RUN_FIRST_FLAGS:
        first, at = struct.unpack_from(">I", data, at)[0], at + 4
    given = [k for k, bit in enumerate((RUN_DURATION, RUN_SIZE, RUN_FLAGS)) if flags & bit]
    width = len(given) + bool(flags & RUN_SHIFT)
    if at + 4 * n * width > end or n > len(data):
        raise ValueError("a run overruns")
    for k in range(n):
        values = list(fragment.usual)
        if k == 0 and first is not None:
            values[2] = first
        for column, i in enumerate(given):
            values[i] = struct.unpack_from(">I", data, at + 4 * (k * width + column))[0]
        if place < 0 or place + values[1] > len(data):
            raise ValueError("a sample lies outside the file")
        fragment.track.pieces.append((place, place + values[1], values[0], not values[2] & NOT_SYNC))
        place += values[1]
    return place


def _walk(data: bytes, at: int, end: int, tracks: list[Track], moof: int = 0) -> None:
    fragment, following, before = None, None, at
    for kind, body, stop in boxes(data, at, end):
        if kind == b"trak":
            tracks.append(Track())
        if kind in PARENTS:
            _walk(data, body, stop, tracks, before if kind == b"moof" else moof)
        elif kind == b"trex":
            number, _, *usual = struct.unpack_from(">5I", data, body + 4)
            for t in tracks:
                if t.number == number:
                    t.usual = tuple(usual)
        elif kind == b"tfhd":
            fragment, following = _fragment(data, body, stop, moof, tracks), None
        elif kind == b"trun" and fragment:
            following = _run(data, body, stop, fragment, following)
        before = stop
        if tracks and kind in (b"tkhd", b"mdhd", b"hdlr", b"stsd", b"stts", b"stss", b"stsc", b"stsz", b"stz2", b"stco", b"co64"):
            _table(tracks[-1], data, kind, body, stop)


def _place(track: Track, total: int) -> None:
    """Byte ranges of the samples: chunk offsets, samples in each chunk and sample sizes put together."""
    sample, run = 0, 0
    for chunk, at in enumerate(track.chunks, 1):
        while run + 1 < len(track.chunk_runs) and track.chunk_runs[run + 1][0] <= chunk:
            run += 1
        for size in track.sizes[sample : sample + (track.chunk_runs[run][1] if track.chunk_runs else 0)]:
            if at + size > total:
                raise ValueError("a sample lies outside the file")
            track.ranges.append((at, at + size))
            at += size
            sample += 1


def probe(data: bytes | None) -> tuple[str, list[Track]]:
    """Status ('ok', 'empty' or 'broken') and the tracks of a container."""
    tracks: list[Track] = []
    if not data:
        return "empty", tracks
    try:
        _walk(data, 0, len(data), tracks)
        for t in tracks:
            _place(t, len(data))
    except (ValueError, struct.error, IndexError):
        return "broken", tracks
    return "ok", tracks


RANGES = "array<struct<start:bigint,end:bigint>>"


def track_row(track: Track) -> dict:
    return {"handler": track.handler, "codec": track.codec.strip(), "duration_s": track.seconds, "n_samples": len(track.samples), "keyframes": [{"start": a, "end": b} for a, b in track.keys]}


def media_columns(df: DataFrame, key: str = "media_id", media: str = "media") -> DataFrame:
    """Codec, duration and keyframe byte ranges of every track of each container; one row per input row, payloads untouched."""

    def read(keys, blobs):
        found = [probe(b) for b in blobs]
        return keys, [s for s, _ in found], [[track_row(t) for t in tracks] for _, tracks in found]

    kind = dict(df.dtypes)[key]
    return map_rows(df, read, f"{key} {kind}, status string, tracks array<struct<handler:string,codec:string,duration_s:double,n_samples:int,keyframes:{RANGES}>>", [key, media], rows=64)


def padded(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (UNIT if not raw else -len(raw) % UNIT)


def store_texts(docs: DataFrame) -> DataFrame:
    """Each whole text stored as a container's samples: doc_id, n_bytes, media. Null and empty texts are one unit of padding."""

    def write(ids, texts):
        return ids, [len(t.encode("utf-8", "surrogatepass")) for t in texts], [mux(padded(t)) for t in texts]

    return map_rows(documents(docs), write, "doc_id bigint, n_bytes bigint, media binary", ["doc_id", "text"], rows=256)


def read_back(stored: DataFrame) -> DataFrame:
    """Digests of the samples and tables read back from the stored bytes, and codec, duration and keyframe byte ranges of the one track."""

    def read(ids, sizes, blobs):
        out = [[] for _ in range(9)]
        for blob in blobs:
            status, tracks = probe(blob)
            if status != "ok" or len(tracks) != 1:
                raise ValueError("a stored container can't be read back")
            t = tracks[0]
            payload = b"".join(blob[a:b] for a, b in t.ranges)
            keys = hashlib.sha256(",".join(f"{a}-{b}" for a, b in t.keys).encode()).hexdigest()[:16]
            feature = f"{t.handler}:{t.codec.strip()}:{t.timescale}:{t.duration}:{len(t.ranges)}:{len(t.keys)}:{keys}"
            for column, value in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), feature, t.codec.strip(), t.seconds, track_row(t)["keyframes"]), strict=True):
                column.append(value)
        return ids, sizes, *out

    return map_rows(stored, read, f"doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, codec string, duration_s double, keyframes {RANGES}", ["doc_id", "n_bytes", "media"], rows=256)
