"""SimHash near-duplicates by tiled exact comparison.

A document's words (between ASCII white space, A-Z lower-cased) form 4-word shingles, repeats included; a bit of the
64-bit fingerprint is 1 if it is set in over half the shingles' XXH64 (seed 42). Distinct fingerprints are dealt to
tiles by their population count and that of their first two 16-bit quarters. Tiles whose counts show that every pair
differs in more than ``radius`` bits are never paired; the others are compared with numpy exclusive-or and bit
counts, in blocks that are skipped by the same bound. A pair of tiles returns a spanning forest of its links, not the
links, so a large group costs its size and not its square; components follow from the forests.

Cases: texts without words (null, empty, blank) have fingerprint zero and link like any other; fewer than four words
make one shingle; repeated rows and rows with equal fingerprints are one node; a null ``doc_id`` is kept, and its
component is the smallest known ``doc_id`` of its group, null if there is none; very long texts are fingerprinted
whole, their shingles' bits counted together; columns other than ``doc_id`` and ``text`` are not read, so their names
cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quarry.llm.common import components, forest, group_arrow, map_arrow, partitions, planes, ship, unplanes, written

SHINGLE = 4
RADIUS = 4
#: A tile has about this many fingerprints, packed in so many pieces; its number grows with the input.
TILE, PIECES = 8192, 8
#: Tasks that pairs of tiles are spread over at most; each takes its pairs one by one.
MOST_TASKS = 20_000
BLOCK = 256
#: Shingles whose bits are counted together.
LONG = 200_000
QUARTERS = np.array([0, 16, 32, 48], np.uint64)

_hash = functools.partial(xxhash.xxh64_intdigest, seed=42)


def shingle_hashes(words: list[bytes], width: int = SHINGLE) -> list[int]:
    """XXH64 of each shingle of some words; of the whole sequence if it is shorter; none without words."""
    joined = b" ".join(words)
    if len(words) <= width:
        return [_hash(joined)] if words else []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-width] + 1])
    return [_hash(joined[a:z]) for a, z in zip(starts.tolist(), ends[width - 1 :].tolist())]


def _bits(hashes: list[int]) -> np.ndarray:
    return np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1)


def fingerprints_of(texts: list[str | None], width: int = SHINGLE) -> np.ndarray:
    """Fingerprints (unsigned 64-bit) of some texts; the shingles of a text over ``LONG`` are counted slice by slice."""
    out = np.zeros(len(texts), np.uint64)
    at: list[int] = []
    sizes: list[int] = []
    hashes: list[int] = []

    def packed(set_in: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.packbits(set_in * 2 > n, axis=1).view("<u8").reshape(-1)

    def done() -> None:
        if at:
            starts = np.cumsum([0, *sizes[:-1]])
            out[at] = packed(np.add.reduceat(_bits(hashes), starts, axis=0, dtype=np.int32), np.array(sizes)[:, None])
            for x in (at, sizes, hashes):
                x.clear()

    for i, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        n = len(words) - width + 1
        if n > LONG:
            set_in = sum(_bits(shingle_hashes(words[a : min(a + LONG, n) + width - 1], width)).sum(axis=0, dtype=np.int64) for a in range(0, n, LONG))
            out[i] = packed(set_in[None], np.array([[n]]))[0]
            continue
        found = shingle_hashes(words, width)
        if found:
            at.append(i)
            sizes.append(len(found))
            hashes += found
        if len(hashes) > LONG:
            done()
    done()
    return out


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint's 64 bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints_of(batch.column(1).to_numpy(zero_copy_only=False).tolist(), width)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def _counts(fp: np.ndarray) -> np.ndarray:
    """Population counts of the whole and of each 16-bit quarter, one column each."""
    quarters = (fp[:, None] >> QUARTERS) & np.uint64(0xFFFF)
    return np.concatenate([np.bitwise_count(fp)[:, None], np.bitwise_count(quarters)], axis=1).astype(np.int16)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least differing bits between any members of ranges ``a`` and ``b`` of counts: arrays [..., 2, columns]."""
    gap = np.maximum(0, np.maximum(a[..., 0, :] - b[..., 1, :], b[..., 0, :] - a[..., 1, :]))
    return np.maximum(gap[..., 0], gap[..., 1:].sum(-1))


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between fingerprints ``a`` and ``b`` (``same``: they are one tile)."""

    def blocks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = _counts(x)
        order = np.lexsort(counts.T[::-1])
        x, counts = x[order], counts[order]
        starts = np.arange(0, len(x), BLOCK)
        return x, np.stack([np.minimum.reduceat(counts, starts), np.maximum.reduceat(counts, starts)], axis=1)

    a, in_a = blocks(a)
    b, in_b = (a, in_a) if same else blocks(b)
    near = _apart(in_a[:, None], in_b[None]) <= radius
    if same:
        near = np.triu(near)
    left, right, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for i, j in zip(*np.nonzero(near)):
        x, y = a[i * BLOCK : (i + 1) * BLOCK], b[j * BLOCK : (j + 1) * BLOCK]
        hit = np.bitwise_count(x[:, None] ^ y[None]) <= radius
        if same and i == j:
            hit = np.triu(hit, 1)
        p, q = np.nonzero(hit)
        if len(p):
            left.append(x[p].view(np.int64))
            right.append(y[q].view(np.int64))
            held += len(p)
        if held > 300_000:
            p, q = forest(np.concatenate(left), np.concatenate(right))
            left, right, held = [p], [q], 0
    return forest(np.concatenate(left), np.concatenate(right))


def _tiles(cells: pd.DataFrame, size: int) -> tuple[pd.DataFrame, int]:
    """Each cell's first tile and number of tiles, and the number of all: tiles hold consecutive cells (population
    counts of the whole, of quarters 0 and 1), a large cell fills several."""
    cells = cells.sort_values(["pop", "q0", "q1"]).reset_index(drop=True)
    first, ways, tiles, filled = [], [], 0, size
    for n in cells["n"].tolist():
        if n > size:
            k = -(-n // size)
            first.append(tiles)
            ways.append(k)
            tiles, filled = tiles + k, size
        else:
            if filled + n > size:
                tiles, filled = tiles + 1, 0
            first.append(tiles - 1)
            ways.append(1)
            filled += n
    return cells.assign(first=first, ways=ways), tiles


def _pairs(cells: DataFrame, radius: int) -> DataFrame:
    """Pairs of tiles (i <= j) whose ranges of population counts do not rule out a link."""
    each = cells.select(F.explode(F.sequence("first", F.col("first") + F.col("ways") - 1)).alias("tile"), "pop", "q0")
    boxes = each.groupBy("tile").agg(F.min("pop").alias("p0"), F.max("pop").alias("p1"), F.min("q0").alias("q0"), F.max("q0").alias("q1"))
    left = boxes.select(F.col("tile").alias("i"), F.struct("p0", "p1", "q0", "q1").alias("a"), F.explode(F.sequence("p0", "p1")).alias("pop"))
    right = boxes.select(F.col("tile").alias("j"), F.struct("p0", "p1", "q0", "q1").alias("b"), F.explode(F.sequence(F.col("p0") - radius, F.col("p1") + radius)).alias("pop"))
    apart = lambda low, high: F.greatest(F.col(f"a.{low}") - F.col(f"b.{high}"), F.col(f"b.{low}") - F.col(f"a.{high}"))
    near = left.join(right, "pop").where((F.col("i") <= F.col("j")) & (apart("p0", "p1") <= radius) & (apart("q0", "q1") <= radius))
    return near.select("i", "j").distinct()


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect what is linked among distinct fingerprints (``fp`` long), as forests."""
    spark = fps.sparkSession
    ship(spark)
    quarter = lambda k: F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long")))
    counted = fps.select("fp", F.bit_count("fp").alias("pop"), quarter(0).alias("q0"), quarter(1).alias("q1"))
    # at most 65 x 17 x 17 cells come to the driver, whatever the input
    cells = counted.groupBy("pop", "q0", "q1").agg(F.count("*").alias("n")).toPandas()
    if not len(cells):
        return spark.createDataFrame([], "a long, b long")
    cells, tiles = _tiles(cells, TILE)
    lookup = spark.createDataFrame(pa.Table.from_pandas(cells[["pop", "q0", "q1", "first", "ways"]].astype("int32"), preserve_index=False))
    mixed = F.xxhash64("fp")
    tile = (F.col("first") + F.pmod(mixed, F.col("ways").cast("long"))).cast("int")
    piece = F.pmod(F.shiftrightunsigned(mixed, 40), F.lit(PIECES))
    dealt = counted.join(F.broadcast(lookup), ["pop", "q0", "q1"]).select(tile.alias("tile"), piece.alias("piece"), "fp")

    def pack(t: pa.Table) -> pa.Table:
        return pa.table({"tile": t.column("tile").slice(0, 1).combine_chunks(), "data": pa.array([planes(t.column("fp").to_numpy())], pa.binary())})

    pieces = group_arrow(dealt.groupBy("tile", "piece"), pack, "tile int, data binary")
    packed = written(pieces.groupBy("tile").agg(F.collect_list("data").alias("data")), "tiles")
    pairs = _pairs(lookup, radius)
    both = pairs.join(packed.select(F.col("tile").alias("i"), F.col("data").alias("x")), "i").join(packed.select(F.col("tile").alias("j"), F.col("data").alias("y")), "j")
    spread = both.repartition(max(partitions(fps), min(tiles * (tiles + 1) // 2, MOST_TASKS)), "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = lambda parts: np.concatenate([unplanes(p.as_buffer(), "u8") for p in parts.values])
        for batch in batches:
            for p, q, x, y in zip(batch["i"].to_pylist(), batch["j"].to_pylist(), batch["x"], batch["y"]):
                a, b = close_pairs(whole(x), whole(y), radius, p == q)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return map_arrow(spread.select("i", "j", "x", "y"), compare, "a long, b long")


def marked(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint of ``text``."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints_of(batch.column(at).to_numpy(zero_copy_only=False).tolist(), width)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp.view(np.int64))], [*batch.schema.names, "fp"])

    return map_arrow(docs, run, StructType([*docs.schema.fields, StructField("fp", LongType())]))


def grouped(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``fp``, ``root`` (one a group) and ``component_id`` of every row."""
    prints = written(fingerprints(docs, width), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    root = components(links(distinct.select("fp"), radius)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = distinct.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 lowercase hex digits) and ``component_id`` of every row."""
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return grouped(docs, radius, width).select("doc_id", digits.alias("fingerprint"), "component_id")
