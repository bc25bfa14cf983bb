"""Embedding near-duplicates by cross-polytope hashing.

Vectors turn through three rounds of random signs and a fast Hadamard transform; the signed axis nearest to the result
is a hash, and several of them make a table's code. A vector enters, in each table, the bucket of its code and those
of the codes with one hash replaced by its second or third choice (multiprobe), so two vectors with a cosine of 0.98
share a bucket of a table with a probability of about 0.96, and of all seven tables with 1 - 1e-9. Buckets with
two or more vectors are compared exactly in double precision; larger ones in pairs of chunks, so that no task holds a
hot bucket. A link counts in the first bucket that both vectors share and nowhere else, which needs no list of pairs:
what leaves a task is a sum per vector and a spanning forest.

Vectors with the same bits and label are one node with a count. The code's length grows with the logarithm of the
number of nodes, so buckets stay small; the number of tables grows with it.

Cases: null labels, null, empty or zero vectors, null or non-finite components, and a null ``vec_id`` link with
nothing (``component_id`` is the row's own ``vec_id``); rows that repeat a vector count as other vectors; vectors of
different lengths are never compared; an empty table gives no rows; only ``vec_id``, ``embedding`` and ``label`` are
read, so other columns' names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import components, forest, map_arrow, partitions, written

LEAST = 0.98
ROUNDS = 3
CHOICES = 3
#: Rows of a bucket that are compared in one block.
CHUNK = 512
#: Codes per node that the code's length aims at.
SPARE = 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x


def signatures(x: np.ndarray, salt: np.ndarray, hashes: int, tables: int) -> np.ndarray:
    """Bucket keys [row, table, probe] of unit vectors; ``salt`` tells apart what must not meet."""
    n, d = x.shape
    width = max(2, 1 << (d - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - d)))
    rng = np.random.default_rng(20250101)
    out = np.zeros((n, tables, 1 + (CHOICES - 1) * hashes), np.uint64)
    choices = min(CHOICES, width)
    for t in range(tables):
        axes = []
        for _ in range(hashes):
            y = x
            for _ in range(ROUNDS):
                y = hadamard(y * rng.choice(np.array([-1.0, 1.0]), width))
            size = np.abs(y)
            best = []
            for _ in range(choices):
                top = size.argmax(axis=1)
                best.append(2 * top + (np.take_along_axis(y, top[:, None], 1)[:, 0] < 0))
                np.put_along_axis(size, top[:, None], -1.0, 1)
            axes.append(best)
        probes = [[0] * hashes] + [[j if k == h else 0 for k in range(hashes)] for h in range(hashes) for j in range(1, CHOICES)]
        for p, picks in enumerate(probes):
            code = salt + np.uint64((t + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            for k, j in enumerate(picks):
                code = (code ^ axes[k][min(j, choices - 1)].astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
                code ^= code >> np.uint64(32)
            out[:, t, p] = code
    return out


def _salt(labels: list[str], widths: np.ndarray) -> np.ndarray:
    known: dict[tuple[str, int], int] = {}
    return np.array([known.setdefault(k, xxhash.xxh64_intdigest(f"{k[1]}:{k[0]}")) for k in zip(labels, widths.tolist())], np.uint64)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of a list column, zero-padded to one width, and their own widths."""
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets).astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)[offsets[0] : offsets[-1]]
    x = np.zeros((len(sizes), int(sizes.max()) if len(sizes) else 0))
    x[np.arange(x.shape[1]) < sizes[:, None]] = flat
    return x / np.sqrt((x * x).sum(axis=1))[:, None], sizes


def _by_width(x: np.ndarray, salt: np.ndarray, hashes: int, tables: int, widths: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), tables, 1 + (CHOICES - 1) * hashes), np.uint64)
    for d in np.unique(widths).tolist():
        at = np.flatnonzero(widths == d)
        out[at] = signatures(x[at, :d], salt[at], hashes, tables)
    return out


def _shared_first(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The key that counts for each pair of signatures: the least one of the first table where they share any."""
    out = np.zeros(len(a), np.uint64)
    todo = np.arange(len(a))
    for t in range(a.shape[1]):
        x, y = a[todo, t], b[todo, t]
        same = (x[:, :, None] == y[:, None, :]).any(axis=2)
        hit = same.any(axis=1)
        out[todo[hit]] = np.where(same[hit], x[hit], np.uint64(2**64 - 1)).min(axis=1)
        todo = todo[~hit]
        if not len(todo):
            break
    return out


class Comparer:
    """Compares the rows of buckets that lie together in a batch; gathers sums and a forest."""

    def __init__(self, least: float, hashes: int, tables: int) -> None:
        self.least, self.hashes, self.tables = least, hashes, tables
        self.reset()

    def reset(self) -> None:
        self.a, self.b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids: list[np.ndarray] = []
        self.sums: list[np.ndarray] = []

    def take(self, key: np.ndarray, group: np.ndarray, side: np.ndarray, node: np.ndarray, copies: np.ndarray, x: np.ndarray, salt: np.ndarray, widths: np.ndarray) -> None:
        """Rows sorted by group; sides 0 and 1 of a group are compared with each other, side 2 with itself."""
        starts = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0]))
        ends = np.concatenate([starts[1:], [len(group)]])
        sizes = ends - starts
        left, right = [], []
        for a, z in zip(starts[sizes > 48].tolist(), ends[sizes > 48].tolist()):
            near = np.triu(x[a:z] @ x[a:z].T >= self.least - 1e-9, 1)
            p, q = np.nonzero(near)
            left.append(p + a)
            right.append(q + a)
        small = np.repeat(sizes <= 48, sizes)
        row = np.flatnonzero(small)
        more = np.repeat(ends, sizes)[row] - row - 1
        for part in np.array_split(np.arange(len(row)), max(1, int(more.sum()) // 100_000)):
            p = np.repeat(row[part], more[part])
            stop = np.cumsum(more[part])
            q = p + 1 + np.arange(len(p)) - np.repeat(stop - more[part], more[part])
            near = np.einsum("ij,ij->i", x[p], x[q]) >= self.least - 1e-9
            left.append(p[near])
            right.append(q[near])
        p, q = np.concatenate(left), np.concatenate(right)
        ok = (salt[p] == salt[q]) & (widths[p] == widths[q]) & (node[p] != node[q]) & ((side[p] == 2) | (side[p] != side[q]))
        p, q = p[ok], q[ok]
        exact = np.concatenate([np.einsum("ij,ij->i", x[i], x[j]) for i, j in zip(np.array_split(p, len(p) // 100_000 + 1), np.array_split(q, len(p) // 100_000 + 1))])
        p, q = p[exact >= self.least], q[exact >= self.least]
        if not len(p):
            return
        self.a, self.b = forest(np.concatenate([self.a, node[p]]), np.concatenate([self.b, node[q]]))
        rows, at = np.unique(np.concatenate([p, q]), return_inverse=True)
        sig = _by_width(x[rows], salt[rows], self.hashes, self.tables, widths[rows])
        i, j = at[: len(p)], at[len(p) :]
        counts = np.concatenate([_shared_first(sig[u], sig[v]) == key[w] for u, v, w in zip(*(np.array_split(k, len(p) // 20_000 + 1) for k in (i, j, p)))])
        p, q = p[counts], q[counts]
        self.ids += [node[p], node[q]]
        self.sums += [copies[q], copies[p]]

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.ids:
            ids, at = np.unique(np.concatenate(self.ids), return_inverse=True)
            sums = np.bincount(at, np.concatenate(self.sums), len(ids)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([None] * len(ids), pa.int64()), pa.array(sums)], ["a", "b", "n"])
        if len(self.a):
            yield pa.RecordBatch.from_arrays([pa.array(self.a), pa.array(self.b), pa.array([None] * len(self.a), pa.int64())], ["a", "b", "n"])
        self.reset()


def links(nodes: DataFrame, least: float = LEAST) -> DataFrame:
    """Rows (a, null, n): n copies are linked to node a; and rows (a, b, null): a forest of the links.

    ``nodes``: node long (unique), copies long, label string, vector array<float> (finite, not zero).
    """
    n = max(2, nodes.count())
    axes = 2 * max(2, nodes.agg(F.max(F.size("vector"))).head()[0] or 2)
    hashes = 2
    while axes**hashes < SPARE * n:
        hashes += 1
    tables = 4 + hashes

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                x, widths = _matrix(part["vector"])
                sig = _by_width(x, _salt(part["label"].to_pylist(), widths), hashes, tables, widths)
                each = sig.reshape(len(x), -1)
                yield pa.RecordBatch.from_arrays([pa.array(each.reshape(-1).view(np.int64)), pa.array(np.repeat(part["node"].to_numpy(), each.shape[1]))], ["key", "node"])

    dealt = written(map_arrow(nodes.select("node", "label", "vector"), codes, "key long, node long"), "codes")
    met = dealt.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    mine = F.pmod(F.xxhash64("node", "key"), F.col("chunks")).cast("int")
    rows = dealt.join(met, "key").withColumn("chunks", chunks).withColumn("mine", mine)
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    rows = rows.select("key", "node", "mine", other)
    rows = rows.select("key", "node", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"))
    full = rows.join(nodes.select("node", "copies", "label", "vector"), "node")
    placed = full.repartition(partitions(nodes), "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Comparer(least, hashes, tables)
        held: pa.Table | None = None

        def done(t: pa.Table) -> None:
            b = t.combine_chunks().to_batches()[0]
            key, i, j = (b[c].to_numpy() for c in ("key", "i", "j"))
            fresh = np.concatenate([[True], (np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)])
            x, widths = _matrix(b["vector"])
            work.take(key.view(np.uint64), np.cumsum(fresh), b["side"].to_numpy(), b["node"].to_numpy(), b["copies"].to_numpy(), x, _salt(b["label"].to_pylist(), widths), widths)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            key, i, j = (held.column(c).to_numpy() for c in ("key", "i", "j"))
            last = np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1]))
            whole = int(last[-1]) + 1 if len(last) else 0
            if whole:
                done(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            done(held)
        yield from work.out()

    return map_arrow(placed.select("key", "i", "j", "side", "node", "copies", "label", "vector"), compare, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row of (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("string").alias("label"))
    fine = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False))
    marked = rows.withColumn("good", good)
    able = marked.where("good").withColumns({"h1": F.xxhash64("label", "vector"), "h2": F.xxhash64("vector", "label", F.lit(1))})
    classes = able.groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.min("label").alias("label"), F.first("vector").alias("vector"))
    classes = written(classes, "vectors")
    found = written(links(classes, least), "links")
    sums = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    root = components(found.where("b is not null").select("a", "b"))
    told = classes.select("h1", "h2", "node", "copies").join(sums, "node", "left").join(root, "node", "left")
    told = told.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = able.select("vec_id", "h1", "h2").join(told, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = marked.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
