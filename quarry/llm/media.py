"""Media columns: walk ISO media containers and decode their sample tables without touching payloads.

``container`` stores bytes as an ISO base media file (ftyp, moov, mdat) whose one track holds 8-bit samples in
64-byte frames, a sync frame every 64 frames. ``describe`` walks any container's nested boxes and returns, per
track, handler, codec, time scale, duration, frame count and the byte ranges of its sync frames.

Cases: null bytes or text count as empty; a truncated or malformed container gives ``error`` and what was read
before it; a container without tracks gives an empty list. Equal input, equal bytes: no clock or random id is
stored, and repeated rows give equal results. A very long text is stored whole, one container a row; an
empty table gives no rows; only the key and the data are read, so other columns' names
cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarry.llm.common import map_arrow

FRAME = 64
FRAMES_PER_CHUNK = 64
TIMESCALE = 8000

#: Boxes that hold boxes (fixed by the file format).
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body if len(body) + 8 < 1 << 32 else struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, flags: int, *parts: bytes) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def padded(data: bytes, unit: int = FRAME) -> bytes:
    """``data`` with zero bytes up to a positive multiple of ``unit``."""
    return data + bytes(-len(data) % unit if data else unit)


def container(payload: bytes) -> bytes:
    """An ISO media file whose only track stores ``payload`` (a multiple of 64 bytes) as 8-bit samples."""
    frames = len(payload) // FRAME
    full, rest = divmod(frames, FRAMES_PER_CHUNK)
    chunks = full + bool(rest)
    runs = [(1, FRAMES_PER_CHUNK, 1)] * bool(full) + [(full + 1, rest, 1)] * bool(rest)
    ticks = len(payload)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    sound = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))

    def moov(first: int) -> bytes:
        starts = [first + i * FRAME * FRAMES_PER_CHUNK for i in range(chunks)]
        offsets = _full(b"stco", 0, struct.pack(f">I{chunks}I", chunks, *starts)) if not chunks or starts[-1] < 1 << 32 else _full(b"co64", 0, struct.pack(f">I{chunks}Q", chunks, *starts))
        stbl = _box(
            b"stbl",
            _full(b"stsd", 0, struct.pack(">I", 1), sound),
            _full(b"stts", 0, struct.pack(">III", 1, frames, FRAME)),
            _full(b"stss", 0, struct.pack(f">I{chunks}I", chunks, *(1 + i * FRAMES_PER_CHUNK for i in range(chunks)))),
            _full(b"stsc", 0, struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", 0, struct.pack(">II", FRAME, frames)),
            offsets,
        )
        dinf = _box(b"dinf", _full(b"dref", 0, struct.pack(">I", 1), _full(b"url ", 1)))
        minf = _box(b"minf", _full(b"smhd", 0, bytes(4)), dinf, stbl)
        mdia = _box(b"mdia", _full(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0)), _full(b"hdlr", 0, bytes(4), b"soun", bytes(12), b"samples\0"), minf)
        tkhd = _full(b"tkhd", 7, struct.pack(">IIIII", 0, 0, 1, 0, ticks), bytes(8), struct.pack(">hhhH", 0, 0, 0x100, 0), MATRIX, bytes(8))
        mvhd = _full(b"mvhd", 0, struct.pack(">IIII", 0, 0, TIMESCALE, ticks), struct.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = 8 if len(payload) + 8 < 1 << 32 else 16
    return b"".join([ftyp, moov(len(ftyp) + len(moov(0)) + head), _box(b"mdat", payload)])


def boxes(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, body start, body end) of each box between ``at`` and ``end``; raises ValueError when one is cut short."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise ValueError("a box header is cut short")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} does not fit")
        yield kind, at + head, at + size
        at += size
    if at != end:
        raise ValueError("bytes follow the last box")


def _entries(data: bytes, at: int, end: int, fmt: str) -> list[tuple]:
    (n,) = struct.unpack_from(">I", data, at + 4)
    size = struct.calcsize(">" + fmt)
    if at + 8 + n * size > end:
        raise ValueError("a sample table is cut short")
    return list(struct.iter_unpack(">" + fmt, data[at + 8 : at + 8 + n * size]))


def _walk(data: bytes, at: int, end: int, tracks: list[dict], movie: dict) -> None:
    for kind, a, z in boxes(data, at, end):
        t = tracks[-1] if tracks else {}
        if kind == b"trak":
            tracks.append({})
        if kind in NESTED:
            _walk(data, a, z, tracks, movie)
        elif kind in (b"mvhd", b"mdhd"):
            long = data[a] == 1
            scale, ticks = struct.unpack_from(">IQ" if long else ">II", data, a + (20 if long else 12))
            (movie if kind == b"mvhd" else t).update(timescale=scale, ticks=ticks)
        elif kind == b"tkhd":
            t["track"] = struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))[0]
        elif kind == b"hdlr" and "track" in t:
            t["handler"] = data[a + 8 : a + 12].decode("latin-1")
        elif kind == b"stsd":
            t["codec"] = next((k.decode("latin-1") for k, _, _ in boxes(data, a + 8, z)), "")
        elif kind == b"stts":
            t["stts"] = _entries(data, a, z, "II")
        elif kind == b"stss":
            t["stss"] = [x for (x,) in _entries(data, a, z, "I")]
        elif kind == b"stsc":
            t["stsc"] = _entries(data, a, z, "III")
        elif kind == b"stsz":
            size, n = struct.unpack_from(">II", data, a + 4)
            t["sizes"] = (size, n) if size else [x for (x,) in _entries(data, a + 4, z, "I")]
        elif kind in (b"stco", b"co64"):
            t["chunks"] = [x for (x,) in _entries(data, a, z, "I" if kind == b"stco" else "Q")]


def samples(t: dict) -> Iterator[tuple[int, int]]:
    """(offset, size) of a track's samples in order, from its chunk offsets, samples per chunk and sizes."""
    sizes, chunks, runs = t.get("sizes", []), t.get("chunks", []), t.get("stsc", [])
    even = isinstance(sizes, tuple)
    n = sizes[1] if even else len(sizes)
    k, run = 0, 0
    for c, at in enumerate(chunks, 1):
        while run + 1 < len(runs) and runs[run + 1][0] <= c:
            run += 1
        for _ in range(runs[run][1] if runs else 0):
            if k == n:
                return
            size = sizes[0] if even else sizes[k]
            yield at, size
            at += size
            k += 1


def describe(data: bytes | None) -> dict:
    """Tracks of a container: codec, duration, frame count and byte ranges of sync frames; payloads stay unread."""
    tracks: list[dict] = []
    movie: dict = {}
    error = None
    try:
        _walk(data or b"", 0, len(data or b""), tracks, movie)
    except (ValueError, struct.error, IndexError) as e:
        error = str(e) or type(e).__name__
    out = []
    for t in tracks:
        sync = set(t["stss"]) if "stss" in t else None
        ranges, n = [], 0
        for n, (at, size) in enumerate(samples(t), 1):
            if sync is None or n in sync:
                ranges.append([at, size])
        scale = t.get("timescale") or 0
        out.append({"track": t.get("track", 0), "handler": t.get("handler", ""), "codec": t.get("codec", ""), "timescale": scale, "ticks": t.get("ticks", 0), "seconds": t.get("ticks", 0) / scale if scale else 0.0, "frames": n, "keyframes": ranges})
    return {"tracks": out, "error": error}


def payload_of(data: bytes) -> bytes:
    """The first track's samples, joined: adjacent samples are read as one slice."""
    tracks: list[dict] = []
    _walk(data, 0, len(data), tracks, {})
    parts, start, end = [], 0, 0
    for at, size in samples(tracks[0]):
        if at != end:
            parts.append(data[start:end])
            start = at
        end = at + size
    parts.append(data[start:end])
    return b"".join(parts)


DESCRIBED = "tracks array<struct<track:long,handler:string,codec:string,timescale:long,ticks:long,seconds:double,frames:long,keyframes:array<struct<offset:long,size:long>>>>, error string"


def media_columns(df: DataFrame, key: str, data: str) -> DataFrame:
    """One row per row of ``df``: its key, and ``tracks`` and ``error`` of the container in binary column ``data``."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {DESCRIBED}"

    want = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(1).to_pylist():
                d = describe(x)
                for t in d["tracks"]:
                    t["keyframes"] = [{"offset": a, "size": b} for a, b in t["keyframes"]]
                rows.append(d)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r["tracks"] for r in rows], want.field(1).type), pa.array([r["error"] for r in rows], pa.string())], schema=want)

    return map_arrow(df.select(key, data), run, schema)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            stored = container(padded(raw))
            back = payload_of(stored)
            seen = describe(stored)["tracks"][0]
            rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-FRAME:]), len(stored), hashlib.sha256(stored).hexdigest(), json.dumps(seen, sort_keys=True, separators=(",", ":"))))
        cols = list(zip(*rows)) if rows else [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_digests(docs: DataFrame) -> DataFrame:
    """Per document: its text stored as a container, read back, and the container's features as JSON."""
    return map_arrow(docs.select("doc_id", "text"), _digests, DIGEST)
