"""Substring deduplication by fixed-block anchors.

A window is ``WINDOW`` consecutive words of one document; a word goes if a window that covers it also starts in a
document with a smaller ``doc_id``. Any window holds a whole aligned block of ``WINDOW // 2`` words, whatever its
offset. So documents are indexed by the hashes of their non-overlapping blocks and probed with the rolling hash at
every word; a hash that meets a block of another document anchors a repeat on both sides. Each anchor is extended to
the windows that contain it, a window is confirmed by 96 bits of hash over all its words, and runs of confirmed
windows are the maximal exact repeats.

Documents are dealt to groups of bounded size. A group sends each distinct hash once, whatever the number of its
documents that hold it, with the least and greatest of them, and what comes back to a group is the set of hashes that
are shared; positions never travel, since a group finds them again in its own texts. So a passage that thousands of
documents share costs a row a group at most, neither its occurrences nor their pairs.

Cases: null or blank text has no words; documents under one window lose nothing; rows with the same ``doc_id`` never
remove each other's words; rows with a null ``doc_id`` neither lose nor remove words; words keep their bytes; very
long texts are hashed in slices of bounded size; an empty table gives no rows; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from quarry.llm.common import cogroup_arrow, group_arrow, map_arrow, planes, portions, ship, unplanes, written

WINDOW = 50
#: Odd multipliers of the rolling hashes, and of the mixing step.
BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
#: Bytes of text that are split together, words that are rolled over together, and bytes that are hashed together.
RUN, SLICE, BYTES = 2 << 20, 1 << 18, 1 << 19
#: A group of documents, and a bucket of hashes, for about so many bytes of (compressed) input.
GROUP_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
#: Bits of an anchor's hash that travel; its bucket adds what tells it apart.
ANCHOR_BITS = 40


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(MIX[0])
    h = (h ^ (h >> np.uint64(33))) * np.uint64(MIX[1])
    return h ^ (h >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    """The powers of ``base`` from 0 to ``n`` at least."""
    found = _POWERS.get(base)
    if found is None or len(found) <= n:
        found = _POWERS[base] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n + (n >> 3), base, np.uint64)]), dtype=np.uint64)
    return found


_POWERS: dict[int, np.ndarray] = {}
#: Bytes of a word are hashed as the digits that a fixed seed deals them, in powers of an odd number.
BYTE_BASE = 0x9FB21C651E98DF25
LETTERS = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64)


class Hashed:
    """The words of some texts and their hashes, by array operations over the texts' bytes."""

    def __init__(self, texts: pa.Array) -> None:
        texts = pc.fill_null(texts, "")
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        byte = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        at -= at[0]
        solid = (byte != 32) & ((byte - np.uint8(9)) > 4)
        edge = np.zeros(len(byte) + 1, bool)  # no word crosses from one text to the next
        edge[at] = True
        apart = np.concatenate([[True], ~solid, [True]])
        starts = np.flatnonzero(solid & (apart[:-2] | edge[:-1]))
        ends = np.flatnonzero(solid & (apart[2:] | edge[1:])) + 1
        self.n = len(starts)
        self.offsets = np.searchsorted(starts, at)
        self.hash = np.empty(self.n, np.uint64)
        cuts = np.searchsorted(starts, np.arange(0, len(byte) + BYTES, BYTES))
        for i, j in zip(cuts.tolist(), cuts[1:].tolist()):
            if i < j:
                low, high = int(starts[i]), int(ends[j - 1])
                powers, back = _powers(BYTE_BASE, high - low), _powers(pow(BYTE_BASE, -1, 1 << 64), high - low)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(LETTERS[byte[low:high]] * powers[: high - low], dtype=np.uint64)])
                a, z = starts[i:j] - low, ends[i:j] - low
                self.hash[i:j] = _mixed((sums[z] - sums[a]) * back[a] + (z - a).astype(np.uint64))

    def rolling(self, width: int, way: int) -> np.ndarray:
        """The hash of the ``width`` words from each word on (those that cross a text's end mean nothing)."""
        h = _mixed(self.hash + np.uint64(way)) if way else self.hash
        out = np.empty(max(0, self.n - width + 1), np.uint64)
        size = min(SLICE, len(out))
        powers, back = _powers(BASE[way], size + width), _powers(pow(BASE[way], -1, 1 << 64), size)
        for a in range(0, len(out), SLICE):
            n = min(SLICE, len(out) - a)
            part = h[a : a + n + width - 1]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * powers[: len(part)], dtype=np.uint64)])
            out[a : a + n] = _mixed((sums[width:] - sums[:-width]) * back[:n])
        return out


def _runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    run = (np.cumsum(size) - size) // RUN
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    yield from ((a, z) for a, z in zip(cuts, cuts[1:]) if z > a)


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The integers of some ranges, joined."""
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)


def _places(offsets: np.ndarray, window: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words that begin a block inside a document of a window at least: where, of which text, and the place in it."""
    sizes = np.diff(offsets)
    sizes = np.where(sizes >= window, sizes - block + 1, 0)
    return _ranges(offsets[:-1], sizes), np.repeat(np.arange(len(sizes)), sizes), _ranges(np.zeros(len(sizes), np.int64), sizes)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _anchor(h: np.ndarray, buckets: int) -> np.ndarray:
    """What is compared of a block's hash: its bucket and its low bits."""
    return (_bucket(h, buckets) << np.uint64(ANCHOR_BITS)) | (h & np.uint64((1 << ANCHOR_BITS) - 1))


# Packed rows: entries of one kind that go from one side to the other.
SENT = "bucket long, of long, kind int, docs binary, sizes binary, hash binary"
NAMES = [x.split()[0] for x in SENT.split(", ")]
KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
PROBE, BLOCK, SEVERAL = 0, 1, 2


def _batch(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), KINDS)] if rows else [pa.array([], k) for k in KINDS], NAMES)


def _dealt(to: np.ndarray, of: int, kind: int, doc: np.ndarray, hashes: list[tuple[np.ndarray, int]]) -> list[tuple]:
    """A row per value of ``to``; ``hashes`` are arrays and how many of their low bytes travel. Documents, in order
    within a row, are run-length coded."""
    if len(to) and (to[1:] < to[:-1]).any():
        order = np.argsort(to, kind="stable")
        to, doc, hashes = to[order], doc[order], [(h[order], n) for h, n in hashes]
    starts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
    ends = np.concatenate([starts[1:], [len(to)]])
    out = []
    for a, z in zip(starts.tolist(), ends.tolist()):
        order = np.argsort(doc[a:z])
        own = doc[a:z][order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        sizes = np.diff(np.concatenate([first, [z - a]]))
        out.append((int(to[a]), of, kind, planes(own[first]), planes(sizes.astype("<u4")), b"".join(planes(h[a:z][order])[: n * (z - a)] for h, n in hashes)))
    return out


def _opened(t: pa.Table, widths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sender, kind, document and hashes of each entry of some packed rows."""
    of, kind, doc, hashes = [], [], [], [[] for _ in widths]
    for sender, k, d, s, h in zip(t.column("of").to_pylist(), t.column("kind").to_pylist(), *(t.column(c) for c in NAMES[3:])):
        own = np.repeat(unplanes(d.as_buffer(), "<i8"), unplanes(s.as_buffer(), "<u4"))
        n = len(own)
        of.append(np.full(n, sender))
        kind.append(np.full(n, k, np.int8))
        doc.append(own)
        raw, used = h.as_buffer().to_pybytes(), 0
        for out, w in zip(hashes, widths):
            out.append(unplanes(raw[used : used + w * n] + bytes((8 - w) * n), "<u8"))
            used += w * n
    return tuple(np.concatenate(x) if x else np.zeros(0, k) for x, k in ((of, np.int64), (kind, np.int8), (doc, np.int64))) + ([np.concatenate(h) if h else np.zeros(0, np.uint64) for h in hashes],)  # type: ignore[return-value]


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts equal keys side by side (by the last key first), and where each run of them starts."""
    order = np.argsort(keys[-1])
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    last = keys[-1][order]
    fresh[1:] = last[1:] != last[:-1]
    for k in keys[:-1]:
        k = k[order]
        if (k[1:] != k[:-1])[~fresh[1:]].any():  # the last key alone does not tell all of them apart: hardly ever
            order = np.lexsort(keys)
            return order, np.flatnonzero(np.logical_or.reduce([np.concatenate([[True], x[1:] != x[:-1]]) for x in (y[order] for y in keys)]))
    return order, np.flatnonzero(fresh)


def _least(doc: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Least and greatest document of each distinct key."""
    order, starts = _groups(*keys)
    if not len(order):
        return doc[:0], doc[:0], [k[:0] for k in keys]
    return np.minimum.reduceat(doc[order], starts), np.maximum.reduceat(doc[order], starts), [k[order[starts]] for k in keys]


def anchors(docs: DataFrame, buckets: int, window: int = WINDOW) -> DataFrame:
    """Per group of documents (``bucket``), the block hashes that it shares with another document."""
    block = window // 2

    def probes(rows: pa.Table) -> pa.Table:
        """Every half-window of a group, with the greatest document that has it; aligned blocks, with the least."""
        texts, ids = rows.column("text").combine_chunks(), rows.column("doc_id").to_numpy()
        kinds: list[list[tuple]] = [[], []]
        for a, z in _runs(texts):
            t = Hashed(texts.slice(a, z - a))
            at, text, place = _places(t.offsets, window, block)
            if not len(at):
                continue
            h, doc = t.rolling(block, 0)[at], ids[a:z][text]
            aligned = place % block == 0
            kinds[PROBE].append((doc, h))
            kinds[BLOCK].append((doc[aligned], h[aligned]))
        out = []
        for kind, held in enumerate(kinds):
            if held:
                doc, h = (np.concatenate(x) for x in zip(*held))
                held.clear()
                least, most, (h,) = _least(doc, h)
                out += _dealt(_bucket(h, buckets).astype(np.int64), rows.column("bucket")[0].as_py(), kind, least if kind else most, [(h, ANCHOR_BITS // 8)])
        return _batch(out)

    def meet(t: pa.Table) -> pa.Table:
        """To each group that has it, each hash of an aligned block that a greater document has too."""
        of, kind, doc, (h,) = _opened(t, [ANCHOR_BITS // 8])
        order, starts = _groups(h)
        of, kind, doc, h = of[order], kind[order], doc[order], h[order]
        least = np.minimum.reduceat(np.where(kind == BLOCK, doc, np.iinfo(np.int64).max), starts)
        most = np.maximum.reduceat(doc, starts)
        live = np.repeat(most > least, np.diff(np.concatenate([starts, [len(h)]]))) & (kind == PROBE)
        h = h[live] | np.uint64(t.column("bucket")[0].as_py() << ANCHOR_BITS)
        return _batch(_dealt(of[live], 0, PROBE, np.zeros(len(h), np.int64), [(h, 8)]))

    sent = group_arrow(docs.select("bucket", "doc_id", "text").groupBy("bucket"), probes, SENT)
    return group_arrow(sent.groupBy("bucket"), meet, SENT)


def _beside(texts: pa.Array, ids: np.ndarray, live: np.ndarray, buckets: int, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, hash, more hash) of the windows that hold a live block."""
    block = window // 2
    for a, z in _runs(texts):
        t = Hashed(texts.slice(a, z - a))
        at, text, _ = _places(t.offsets, window, block)
        if not len(at):
            continue
        hit = _among(_anchor(t.rolling(block, 0)[at], buckets), live)
        at, text = at[hit], text[hit]
        # windows from the one that ends with the block to the one that begins with it
        cover = np.zeros(t.n + 1, np.int32)
        np.add.at(cover, np.maximum(at - block, t.offsets[text]), 1)
        np.add.at(cover, at + 1, -1)
        sizes = np.diff(t.offsets)
        last = np.repeat(t.offsets[1:] - window, sizes)
        starts = np.flatnonzero((np.cumsum(cover)[:-1] > 0) & (np.arange(t.n) <= last))
        if len(starts):
            yield np.repeat(ids[a:z], sizes)[starts], t.rolling(window, 0)[starts], t.rolling(window, 1)[starts] & np.uint64(0xFFFFFFFF)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def repeats(docs: DataFrame, marks: DataFrame, buckets: int, window: int = WINDOW) -> DataFrame:
    """Per group of documents (``bucket``), the windows that it shares and the least document that has each."""

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        """Each distinct window beside a live block of a group, with the least document that has it."""
        _, _, _, (live,) = _opened(right, [8])
        held = []
        if len(live) and left.num_rows:
            held = list(_beside(left.column("text").combine_chunks(), left.column("doc_id").to_numpy(), np.sort(live), buckets, window))
        if not held:
            return _batch([])
        doc, h, more = (np.concatenate(x) for x in zip(*held))
        least, most, (more, h) = _least(doc, more, h)
        out, of = [], left.column("bucket")[0].as_py()
        for kind, some in ((PROBE, least == most), (SEVERAL, least < most)):
            out += _dealt(_bucket(h[some], buckets).astype(np.int64), of, kind, least[some], [(h[some], 8), (more[some], 4)])
        return _batch(out)

    def confirm(t: pa.Table) -> pa.Table:
        """To each group with a greater document, each window and the least document of all that has it."""
        of, kind, doc, (h, more) = _opened(t, [8, 4])
        order, starts = _groups(more, h)
        of, kind, doc, h, more = (x[order] for x in (of, kind, doc, h, more))
        least = np.repeat(np.minimum.reduceat(doc, starts), np.diff(np.concatenate([starts, [len(h)]])))
        some = (doc > least) | (kind == SEVERAL)
        return _batch(_dealt(of[some], 0, PROBE, least[some], [(h[some], 8), (more[some], 4)]))

    sent = cogroup_arrow(docs.groupBy("bucket"), marks.groupBy("bucket"), extend, SENT)
    return group_arrow(sent.groupBy("bucket"), confirm, SENT)


RESULT = StructType(
    [
        StructField("n_words", LongType()),
        StructField("n_removed", LongType()),
        StructField("kept", StringType()),
        StructField("repeats", ArrayType(StructType([StructField("start", LongType()), StructField("length", LongType())]))),
    ]
)
REPEATS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def _removed(texts: pa.Array, ids: np.ndarray, shared: pa.Table, window: int) -> dict[int, np.ndarray]:
    """Starts of the windows that go, by row, in order."""
    _, _, least, (h, more) = _opened(shared, [8, 4])
    order = np.lexsort((more, h))
    h, more, least = h[order], more[order], least[order]
    out: dict[int, np.ndarray] = {}
    for a, z in _runs(texts) if len(h) else ():
        t = Hashed(texts.slice(a, z - a))
        at, text, place = _places(t.offsets, window, window)
        own = t.rolling(window, 0)[at] if len(at) else np.zeros(0, np.uint64)
        hit = np.flatnonzero(_among(own, h))
        if not len(hit):
            continue
        at, text, place, own = at[hit], text[hit], place[hit], own[hit]
        rest = t.rolling(window, 1)[at] & np.uint64(0xFFFFFFFF)
        k = np.searchsorted(h, own)
        while (wrong := (more[k] != rest) & (k + 1 < len(h)) & (h[np.minimum(k + 1, len(h) - 1)] == own)).any():
            k = k + wrong  # another window with the same first 64 bits
        gone = (more[k] == rest) & (ids[a:z][text] > least[k])
        text, place = text[gone], place[gone]
        cut = np.flatnonzero(np.diff(text)) + 1
        for i, p in zip(np.split(text, cut), np.split(place, cut)):
            if len(i):
                out[a + int(i[0])] = p
    return out


def _kept(rows: pa.Table, removed: dict[int, np.ndarray], window: int) -> pa.Table:
    """``rows`` (all but the bucket) with the columns of ``RESULT``."""
    n, gone, kept, spans = [], [], [], []
    for i, text in enumerate(rows.column("text").combine_chunks()):
        words = text.as_buffer().to_pybytes().split() if text.is_valid else []
        n.append(len(words))
        starts = removed.get(i)
        runs: list[tuple[int, int]] = []
        if starts is not None:
            new = np.concatenate([[True], np.diff(starts) > window])
            ends = starts[np.concatenate([new[1:], [True]])] + window
            runs = list(zip(starts[new].tolist(), ends.tolist()))
        rest, at = [], 0
        for a, z in runs:
            rest += words[at:a]
            at = z
        rest += words[at:]
        gone.append(len(words) - len(rest))
        kept.append(b" ".join(rest).decode())
        spans.append([{"start": a, "length": z - a} for a, z in runs])
    new = {"n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept": pa.array(kept, pa.string()), "repeats": pa.array(spans, REPEATS)}
    for name, column in new.items():
        rows = rows.append_column(name, column)
    return rows


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``kept`` (the kept words joined by one space) and ``repeats`` (the
    maximal repeats that go, as word ranges). Columns of these names and ``bucket`` are replaced."""
    ship(docs.sparkSession)
    docs = docs.drop(*RESULT.names, "bucket").withColumn("doc_id", F.col("doc_id").cast("long"))
    groups, buckets = portions(docs.select("doc_id", "text"), GROUP_BYTES), portions(docs.select("doc_id", "text"), BUCKET_BYTES)
    known = docs.where("doc_id is not null").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    marks = written(anchors(known, buckets, window), "anchors")
    again = repeats(known, marks, buckets, window)
    schema = StructType([*docs.schema.fields, *RESULT.fields])
    names = docs.columns

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.select(names)
        gone = _removed(rows.column("text").combine_chunks(), rows.column("doc_id").to_numpy(), right, window) if rows.num_rows else {}
        return _kept(rows, gone, window)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _kept(pa.Table.from_batches([batch]), {}, window).to_batches()

    cut = cogroup_arrow(known.groupBy("bucket"), again.groupBy("bucket"), remove, schema)
    return cut.unionByName(map_arrow(docs.where("doc_id is null"), untouched, schema))
