"""Token-id files: an adaptive context-mixing coder over independently reset, checksummed blocks.

Ids are cut into blocks of ``BLOCK``. In a block, order-2 and order-1 tables (by hashes of the last two ids and of the
last one) each predict the next id with a confidence. An integer logistic mixer joins what the order-2 confidence, the
order-1 confidence and the recent run of hits say about "the prediction is right", and that flag is arithmetic-coded.
A miss codes the id itself under an adaptive order-0 model: its four hex digits, each under a distribution of sixteen
that belongs to the digits before it and moves towards what it sees. All state starts afresh in each block, and all
arithmetic is on integers, so any machine decodes what another wrote.

``write`` and ``read`` code in the JVM, a block after the other with its state in a core's cache (``TokenIds.java``).
``pack`` and ``unpack`` are the same coder without Spark, one numpy lane a block; the bytes are the same.

A record holds whole documents: a header, each document's key and length, and its blocks with length, kind and CRC-32
of the ids (a block that would not shrink is stored raw). ``write`` gives a DataFrame of records to be stored as a
Parquet table; ``read`` decodes one record at a time and fails when a checksum does (``unpack``: ValueError).

Cases: null or empty text has the end id alone; a document longer than a record gets a record of its own, whose ids
are held whole in a worker and in the JVM (two bytes each there, in several copies; a thousand million ids at most);
ids of 2^16 and more are stored raw; rows that repeat a ``doc_id`` follow each other in any order; an empty table gives no records.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import map_arrow, partitions, planes, unplanes, written
from quarry.llm.jvm import binary
from quarry.llm.words import key as key_of
from quarry.llm.words import words

MAGIC = b"QIDS0001"
BLOCK = 2048
#: Ids that a record holds, more only for one long document; blocks that are coded side by side.
RECORD, LANES = 4 << 20, 2048
#: Bytes of text that are encoded together.
TEXT = 4 << 20
SLOTS = 2048
RATE, LEARN = 4, 6

#: Logistic tables in 12 bits: squash turns a logit (times 256, -2047 to 2047) into a probability, stretch back.
SQUASH = np.array([min(4095, max(1, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], np.int32)
STRETCH = np.array([min(2047, max(-2047, round(256 * math.log((p + 0.5) / (4095.5 - p))))) for p in range(4096)], np.int32)


SCALE = 15
TOP, BOTTOM = np.uint32(1 << 24), np.uint32(1 << 16)
#: Where a digit's cumulative distribution moves when digit s is seen; every digit keeps at least 1/512.
DIGIT = 16
FLOOR = 64
TARGET = np.array([[j * FLOOR + (0 if j <= s else (1 << SCALE) - DIGIT * FLOOR) for j in range(DIGIT)] for s in range(DIGIT)], np.int16)
ONES = np.uint64(0x0101010101010101)
FLAT = np.arange(0, 1 << SCALE, (1 << SCALE) // DIGIT).astype(np.int16)
#: A cell that predicts nothing: more than any coded id, without trust.
NONE = 1 << 20
#: Distributions per lane: of the first digit, the second, the third, and hashed ones of the last.
TABLES = 1 + 16 + 256 + 512


def _settled(low: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Which intervals give a byte: the first is settled, or they are too tight."""
    return np.flatnonzero(((low ^ (low + wide)) < TOP) | (wide < BOTTOM))


def _narrowed(rows: np.ndarray | slice, low: np.ndarray, wide: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows, low ends and widths of the intervals ``at``, and the widths that end with the byte."""
    rows = at if isinstance(rows, slice) else rows.take(at)
    low, wide = low.take(at), wide.take(at)
    return rows, low, wide, np.where((low ^ (low + wide)) < TOP, wide, (~low + np.uint32(1)) & (BOTTOM - np.uint32(1)))


def _span(below: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's digit starts in its cumulative distribution, and its size."""
    at = np.arange(0, len(value) * DIGIT, DIGIT) + value
    flat = below.reshape(-1)
    start = flat.take(at).astype(np.int32)
    end = np.where(value == DIGIT - 1, 1 << SCALE, flat.take(at + 1, mode="clip").astype(np.int32))
    return start, end - start


class _Encoder:
    """Carry-less range encoder with one interval per lane."""

    def __init__(self, lanes: int) -> None:
        self.low = np.zeros(lanes, np.uint32)
        self.range = np.full(lanes, 0xFFFFFFFF, np.uint32)
        self.out = np.zeros((lanes, 4 * BLOCK + 64), np.uint8)
        self.n = np.zeros(lanes, np.int64)
        self.lanes = np.arange(lanes)

    def _byte(self, rows: np.ndarray, byte: np.ndarray) -> None:
        # a block that outgrows its room is stored raw, so what it loses is not read
        n = self.n.take(rows)
        self.out.reshape(-1)[rows * self.out.shape[1] + np.minimum(n, self.out.shape[1] - 1)] = byte
        self.n[rows] = n + 1

    def put(self, rows: np.ndarray | slice, start: np.ndarray, size: np.ndarray) -> None:
        """Narrows the intervals to [start, start + size) of 2^15."""
        unit = self.range[rows] >> np.uint32(SCALE)
        low, wide = self.low[rows] + unit * start.astype(np.uint32), unit * size.astype(np.uint32)
        self.low[rows], self.range[rows] = low, wide
        while True:
            at = _settled(low, wide)
            if not len(at):
                return
            rows, low, wide, narrow = _narrowed(rows, low, wide, at)
            self._byte(rows, low >> np.uint32(24))
            low, wide = low << np.uint32(8), narrow << np.uint32(8)
            self.low[rows], self.range[rows] = low, wide

    def flag(self, n: int, p: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Codes a flag of each of the first ``n`` lanes."""
        self.put(slice(0, n), p * ~hit, np.where(hit, p, (1 << SCALE) - p))
        return hit

    def digit(self, rows: np.ndarray, below: np.ndarray, value: np.ndarray) -> np.ndarray:
        self.put(rows, *_span(below, value))
        return value

    def done(self) -> list[bytes]:
        for k in range(4):
            self._byte(self.lanes, (self.low >> np.uint32(24 - 8 * k)) & np.uint32(255))
        return [row[:n].tobytes() if n <= len(row) else b"" for row, n in zip(self.out, self.n.tolist())]


class _Decoder:
    """The reverse of :class:`_Encoder`."""

    def __init__(self, blocks: list[bytes]) -> None:
        self.data = np.zeros((len(blocks), max(map(len, blocks)) + 8), np.uint8)
        for row, b in zip(self.data, blocks):
            row[: len(b)] = np.frombuffer(b, np.uint8)
        self.low = np.zeros(len(blocks), np.uint32)
        self.range = np.full(len(blocks), 0xFFFFFFFF, np.uint32)
        self.x = np.zeros(len(blocks), np.uint32)
        for k in range(4):
            self.x = (self.x << np.uint32(8)) | self.data[:, k]
        self.n = np.full(len(blocks), 4, np.int64)
        self.lanes = np.arange(len(blocks))

    def _at(self, rows: np.ndarray | slice) -> np.ndarray:
        unit = self.range[rows] >> np.uint32(SCALE)
        return np.minimum((self.x[rows] - self.low[rows]) // unit, np.uint32((1 << SCALE) - 1)).astype(np.int32)

    def _took(self, rows: np.ndarray | slice, start: np.ndarray, size: np.ndarray) -> None:
        unit = self.range[rows] >> np.uint32(SCALE)
        low, wide = self.low[rows] + unit * start.astype(np.uint32), unit * size.astype(np.uint32)
        self.low[rows], self.range[rows] = low, wide
        while True:
            at = _settled(low, wide)
            if not len(at):
                return
            rows, low, wide, narrow = _narrowed(rows, low, wide, at)
            n = self.n.take(rows)
            more = self.data.take(rows * self.data.shape[1] + np.minimum(n, self.data.shape[1] - 1))
            self.n[rows] = n + 1
            self.x[rows] = (self.x.take(rows) << np.uint32(8)) | more
            low, wide = low << np.uint32(8), narrow << np.uint32(8)
            self.low[rows], self.range[rows] = low, wide

    def flag(self, n: int, p: np.ndarray, hit: np.ndarray | None) -> np.ndarray:
        rows = slice(0, n)
        hit = self._at(rows) < p
        self._took(rows, p * ~hit, np.where(hit, p, (1 << SCALE) - p))
        return hit

    def digit(self, rows: np.ndarray, below: np.ndarray, value: np.ndarray | None) -> np.ndarray:
        upto = (below <= self._at(rows).astype(np.int16)[:, None]).view(np.uint64)  # a byte a digit, added up eight at once
        value = (((upto[:, 0] + upto[:, 1]) * ONES) >> np.uint64(56)).astype(np.int64) - 1
        self._took(rows, *_span(below, value))
        return value


def _run(coder: _Encoder | _Decoder, ids: np.ndarray, sizes: np.ndarray, known: bool) -> None:
    """Codes [lane, step] ``ids`` (filled in when they are not ``known``). Lanes come in falling order of size."""
    lanes = len(sizes)
    cells = [np.full(lanes * SLOTS, NONE, np.int32) for _ in range(2)]  # what order 2 and order 1 predict, times 16, and their trust
    told = np.full(lanes * 80, 2048, np.int32)  # by each order's confidence and agreement, and by the last four flags
    weight = np.full((3, lanes), 22000, np.int32)
    digits = np.broadcast_to(FLAT, (lanes * TABLES, DIGIT)).copy()
    one, run, mixed_one, mixed_two = (np.zeros(lanes, np.int64) for _ in range(4))
    every = np.arange(lanes)
    slots, places = every * SLOTS, every * 80
    open_ = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), "left")  # lanes still open at each step
    for t, n in enumerate(open_.tolist()):
        slot = [slots[:n] + (((mixed_two[:n] + one[:n] * 40503) >> 7) & (SLOTS - 1)), slots[:n] + ((mixed_one[:n] >> 9) & (SLOTS - 1))]
        found = [cells[k].take(slot[k]) for k in (0, 1)]
        guess, sure = [x >> 4 for x in found], [x & 15 for x in found]
        agree = guess[0] == guess[1]
        best = np.where(sure[0] > 0, guess[0], guess[1])
        cell = np.empty((3, n), np.int64)
        cell[0] = sure[0] * 2 + agree
        cell[1] = sure[1] * 2 + ((sure[0] == 0) | agree) + 32
        cell[2] = run[:n] + 64
        cell += places[:n]
        p = told.take(cell)
        s = STRETCH.take(p)
        now = weight[:, :n]
        dot = (now * s).sum(axis=0, dtype=np.int32) >> 16
        mixed = SQUASH.take(np.minimum(np.maximum(dot, -2047), 2047) + 2047)
        hit = coder.flag(n, np.maximum(mixed * 8, 16), ids[:n, t] == best if known else None)
        goal = hit * np.int32(4095)
        now += (s * (goal - mixed)) >> LEARN
        np.minimum(now, 200_000, out=now)
        np.maximum(now, -200_000, out=now)
        told[cell] = p + ((goal - p) >> RATE)
        run[:n] = ((run[:n] << 1) | hit) & 15
        missed = np.flatnonzero(~hit)
        if not known:
            ids[:n, t] = best
        if len(missed):
            ids[missed, t] = _literal(coder, digits, missed, ids[missed, t].astype(np.int64) if known else None)
        x = ids[:n, t]
        for k in (0, 1):
            lower = sure[k] >> 1
            kept = np.where(lower > 0, guess[k], x) << 4
            cells[k][slot[k]] = kept + np.where(guess[k] == x, np.minimum(sure[k] + 1, 15), np.maximum(lower, 1))
        mixed_two[:n] = mixed_one[:n]
        one[:n] = x
        mixed_one[:n] = one[:n] * 2654435761


def _literal(coder: _Encoder | _Decoder, digits: np.ndarray, rows: np.ndarray, value: np.ndarray | None) -> np.ndarray:
    """Codes ids digit by digit, each under the adaptive distribution that the digits before it select."""
    base = rows * TABLES
    so_far = np.zeros(len(rows), np.int64)
    for k in range(4):
        at = base + (so_far if k < 3 else (so_far * 2654435761 >> 11) & 511)
        below = digits.take(at, axis=0)
        got = coder.digit(rows, below, None if value is None else (value >> (12 - 4 * k)) & 15)
        below += (TARGET.take(got, axis=0) - below) >> 5
        digits[at] = below
        so_far = so_far << 4 | got
        base = base + (1, 16, 256, 0)[k]
    return so_far


def pack(ids: np.ndarray) -> bytes:
    """Blocks of an array of unsigned 32-bit ids."""
    cuts = np.arange(0, len(ids), BLOCK)
    sizes = np.minimum(len(ids) - cuts, BLOCK)
    coded = [b""] * len(cuts)
    if len(ids) and ids.max() < 1 << 16:
        for k in range(0, len(cuts), LANES):
            some = cuts[k : k + LANES].tolist()
            lanes = np.zeros((len(some), BLOCK), np.int32)
            for lane, a in zip(lanes, some):
                part = ids[a : a + BLOCK]
                lane[: len(part)] = part
            coder = _Encoder(len(some))
            _run(coder, lanes, sizes[k : k + LANES], True)
            coded[k : k + LANES] = coder.done()
    parts = [struct.pack("<I", len(cuts))]
    for a, n, c in zip(cuts.tolist(), sizes.tolist(), coded):
        raw = ids[a : a + n].astype("<u4").tobytes()
        kind = int(0 < len(c) < len(raw))
        body = c if kind else raw
        parts += [struct.pack("<IBII", n, kind, len(body), zlib.crc32(raw)), body]
    return b"".join(parts)


def unpack(data: bytes) -> np.ndarray:
    """The ids of :func:`pack`; ValueError when a block's checksum fails."""
    (count,) = struct.unpack_from("<I", data)
    at = 4
    heads, bodies = [], []
    for _ in range(count):
        n, kind, size, crc = struct.unpack_from("<IBII", data, at)
        at += 13
        heads.append((n, kind, crc))
        bodies.append(data[at : at + size])
        at += size
    coded = [i for i, h in enumerate(heads) if h[1]]
    out: list[np.ndarray] = [np.frombuffer(b, "<u4") if not h[1] else np.zeros(0, "<u4") for h, b in zip(heads, bodies)]
    coded.sort(key=lambda i: -heads[i][0])
    for k in range(0, len(coded), LANES):
        some = coded[k : k + LANES]
        sizes = np.array([heads[i][0] for i in some])
        lanes = np.zeros((len(some), BLOCK), np.int32)
        _run(_Decoder([bodies[i] for i in some]), lanes, sizes, False)
        for row, i in zip(lanes, some):
            out[i] = row[: heads[i][0]].astype("<u4")
    for (_, _, crc), ids in zip(heads, out):
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError("a block's checksum fails")
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def _head(keys: list[int], sizes: list[int]) -> bytes:
    """What precedes a record's blocks. A null key is stored as the least 64-bit integer."""
    table = planes(np.array([-(1 << 63) if k is None else k for k in keys], "<i8")) + planes(np.array(sizes, "<u4"))
    table = zlib.compress(table, 1)
    return MAGIC + struct.pack("<III", len(keys), len(table), zlib.crc32(table)) + table


def record(keys: list[int], sizes: list[int], ids: np.ndarray) -> bytes:
    """A record of whole documents."""
    return _head(keys, sizes) + pack(ids)


def _listed(data: bytes) -> tuple[list[int | None], np.ndarray, int]:
    """(keys, sizes) of a record, and where its blocks begin."""
    if data[:8] != MAGIC:
        raise ValueError("not a record of token ids")
    n, size, crc = struct.unpack_from("<III", data, 8)
    table = data[20 : 20 + size]
    if zlib.crc32(table) != crc:
        raise ValueError("a record's table fails its checksum")
    table = zlib.decompress(table)
    keys = [None if k == -(1 << 63) else k for k in unplanes(table[: 8 * n], "<i8").tolist()]
    return keys, unplanes(table[8 * n :], "<u4").astype(np.int64), 20 + size


def opened(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(keys, sizes, ids) of a record."""
    keys, sizes, at = _listed(data)
    return keys, sizes, unpack(data[at:])


def sent(ids: np.ndarray) -> bytes:
    """Ids on their way to the JVM: two bytes each where that is enough for all, else four."""
    return ids.astype("<u4" if len(ids) and ids.max() >> 16 else "<u2").tobytes()


PLAIN = "shard int, part int, start long, n_ids long, head binary, ids binary"


def write(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Records of all documents' ids, an end id after each, in ascending ``doc_id`` order: by shard, then part.

    ``start`` counts the ids before a record in its shard. Sorting spreads rows of one ``doc_id`` by their text.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions(docs), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = words(path)
        shard, part, start, held = TaskContext.get().partitionId(), 0, 0, 0
        keys: list[int] = []
        sizes: list[int] = []
        parts: list[np.ndarray] = []
        end = np.array([end_id], "<u4")

        def done() -> pa.RecordBatch:
            nonlocal part, start, held
            row = [[shard], [part], [start], [held], [_head(keys, sizes)], [sent(np.concatenate(parts))]]
            part, start, held = part + 1, start + held, 0
            for x in (keys, sizes, parts):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["shard", "part", "start", "n_ids", "head", "ids"])

        for batch in batches:
            own = batch.column(0).to_pylist()
            for first, flat, offsets in encoder.encode_batches(batch.column(1), TEXT):
                for key, a, z in zip(own[first:], offsets.tolist(), offsets[1:].tolist()):
                    if held and held + z - a + 1 > RECORD:
                        yield done()
                    keys.append(key)
                    sizes.append(z - a + 1)
                    parts += [flat[a:z], end]
                    held += z - a + 1
        if held:
            yield done()

    plain = map_arrow(ordered, run, PLAIN, key_of(path))
    return plain.select("shard", "part", "start", "n_ids", binary(docs.sparkSession, "TokenIds", "Pack", "head", "ids", "n_ids").alias("data"))


def read(records: DataFrame) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before), ``n_tokens`` and ``ids`` (array of int) of each document."""
    return _each(records, "ids array<int>", lambda ids: pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))


def _each(records: DataFrame, field: str, make) -> DataFrame:
    totals = records.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row a shard
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    placed = records.join(before, "shard").select((F.col("before") + F.col("start")).alias("start"), "data", binary(records.sparkSession, "TokenIds", "Unpack", "data").alias("ids"))
    name = field.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data, ids in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                keys, sizes, _ = _listed(data.as_buffer().to_pybytes())
                n = int(sizes.sum())
                ids = np.frombuffer(ids.as_buffer(), "<u2" if len(ids.as_buffer()) == 2 * n else "<u4").astype("<u4", copy=False)
                ends = np.cumsum(sizes)
                for k in range(0, len(keys), 2000):
                    a, z = (ends - sizes)[k : k + 2000], ends[k : k + 2000]
                    each = [ids[x:y] for x, y in zip(a.tolist(), z.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 2000], pa.int64()), pa.array(a + start), pa.array(z - a), make(each)], ["doc_id", "start", "n_tokens", name])

    return map_arrow(placed, run, f"doc_id long, start long, n_tokens long, {field}")


def digests(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Per document, from the written records: start, number of ids and their CRC-32."""
    records = written(write(docs, path, end_id), "token-ids")
    return _each(records, "ids_crc32 long", lambda ids: pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()))
