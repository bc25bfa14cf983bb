"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

A document longer than a window fills whole windows with its front. What remains is cut into pieces of at most a
quarter window, which join a group of pieces of the same partition. ``differencing`` deals a group's pieces
to ``m`` windows: each piece starts as a partial partition of its own, the two with the widest imbalance merge, the
fullest slot of one with the emptiest of the other, until one is left, so sums come out nearly equal. ``m`` starts
at the least number of windows that could hold the group and rises while any window exceeds its capacity. Groups
are bounded and never cross a partition, so nothing is shuffled and a lost task repeats itself exactly.

Cases: null text counts as empty, an empty document is the end id alone, repeated rows are packed each on its own,
very long texts fill whole windows one by one, an empty table gives no pieces; only ``doc_id`` and ``text`` are read,
so other columns' names cannot clash.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_arrow
from quarry.llm.words import key, words

WINDOW = 4096
#: Pieces that are dealt out together.
GROUP = 2048


def _differenced(sizes: np.ndarray, m: int) -> tuple[np.ndarray, list[list[int]]]:
    """Sums and members of ``m`` windows after merging all partial partitions."""
    left: list[np.ndarray] = []  # members joined by each merge, as trees: node n + k joins left and right
    right: list[np.ndarray] = []
    nodes = len(sizes)
    # a partial partition has the filled slots alone, fullest first
    heap = [(-size, i, np.array([size]), np.array([i])) for i, size in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, sums, tree = heapq.heappop(heap)
        _, _, other, more = heapq.heappop(heap)
        n, shared = len(sums), len(sums) + len(other) - m
        other, more = other[::-1], more[::-1]
        if shared > 0:
            left.append(tree[n - shared :])
            right.append(more[:shared])
            sums = np.concatenate([sums[: n - shared], sums[n - shared :] + other[:shared], other[shared:]])
            tree = np.concatenate([tree[: n - shared], np.arange(nodes, nodes + shared), more[shared:]])
            nodes += shared
        else:
            sums, tree = np.concatenate([sums, other]), np.concatenate([tree, more])
        order = (-sums).argsort(kind="stable")
        sums, tree = sums[order], tree[order]
        heapq.heappush(heap, ((int(sums[-1]) if len(sums) == m else 0) - int(sums[0]), tick, sums, tree))
        tick += 1
    lefts = np.concatenate(left).tolist() if left else []
    rights = np.concatenate(right).tolist() if right else []
    n, out = len(sizes), []
    for root in heap[0][3].tolist():
        members, todo = [], [root]
        while todo:
            x = todo.pop()
            if x < n:
                members.append(x)
            else:
                todo += [lefts[x - n], rights[x - n]]
        out.append(sorted(members))
    return heap[0][2], out


def differencing(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Indices of ``sizes`` by window; each window's sum is at most ``capacity``. Sizes over it raise ValueError."""
    a = np.asarray(sizes, np.int64)
    if not len(a):
        return []
    if a.max() > capacity:
        raise ValueError("a piece exceeds the capacity")
    m = max(-(-int(a.sum()) // capacity), int((a > capacity // 2).sum()), 1)
    while True:
        sums, members = _differenced(a, m)
        over = int(np.maximum(sums - capacity, 0).sum())
        if not over:
            return [x for x in members if x]
        m = min(len(a), m + max(1, over // capacity))


def cuts(n: int, window: int = WINDOW) -> tuple[int, list[int]]:
    """How many whole windows ``n`` tokens fill, and the lengths of the pieces of the rest."""
    whole, rest = divmod(n, window)
    most = max(1, window // 4)
    return whole, [most] * (rest // most) + [rest % most] * bool(rest % most)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
FIELDS = [x.split()[0] for x in PIECES.split(", ")]


def pack_texts(docs: DataFrame, path: str, end_id: int, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """Pieces of all documents' ids (an end id after each) with their sequence and offset.

    ``sequence_id`` is the partition's number times 2^40 plus a count, so it is unique and a repeated task gives
    the same ids again.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = words(path)
        number = TaskContext.get().partitionId() << 40
        done: list[tuple] = []
        loose: list[tuple] = []

        def dealt() -> None:
            nonlocal number
            for members in differencing([x[2] for x in loose], window):
                offset = 0
                for i in members:
                    done.append((*loose[i], number, offset))
                    offset += loose[i][2]
                number += 1
            loose.clear()

        def out() -> Iterator[pa.RecordBatch]:
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done)], FIELDS)
                done.clear()

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, flat, offsets in encoder.encode_batches(batch.column(1)):
                data, offsets = flat.tobytes(), offsets.tolist()
                for doc, a, z in zip(keys[first:], offsets, offsets[1:]):
                    ids = data[4 * a : 4 * z] + end
                    n = z - a + 1
                    whole, rest = cuts(n, window)
                    at = 0
                    for _ in range(whole):
                        done.append((doc, at, window, zlib.crc32(ids[4 * at : 4 * (at + window)]), n, number, 0))
                        at += window
                        number += 1
                    for size in rest:
                        loose.append((doc, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), n))
                        at += size
                    if len(loose) >= group:
                        dealt()
            yield from out()
        dealt()
        yield from out()

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, PIECES, key(path))


def sequences(pieces: DataFrame, tokens: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """The packed sequences themselves: ``sequence_id``, ``ids``, ``doc_ids`` and ``n_padding``.

    ``tokens`` has ``doc_id`` (unique) and ``ids``. A sequence is at most one window, so its group is bounded;
    a sequence whose length is a power of two is not padded.
    """
    cut = pieces.join(tokens.select("doc_id", "ids"), "doc_id").select("sequence_id", "offset", "doc_id", F.expr("slice(ids, cast(start + 1 as int), cast(length as int))").alias("part"))
    rows = cut.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "part"))).alias("p"))
    rows = rows.select("sequence_id", F.flatten(F.col("p.part")).alias("ids"), F.col("p.doc_id").alias("doc_ids"))
    n = F.size("ids")
    lacking = F.when(F.expr("bit_count(size(ids))") == 1, F.lit(0)).otherwise(F.lit(window) - n)
    return rows.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad), lacking)).alias("ids"), "doc_ids", lacking.alias("n_padding"))
