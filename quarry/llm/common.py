"""What the training-data operators share: shipping code, sizing shuffles, cutting lineage, components."""

from __future__ import annotations

import atexit
import contextlib
import io
import itertools
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: One shuffle partition for about this many bytes of (compressed) input.
TARGET_PARTITION_BYTES = 8 << 20
#: Arrow batches between the JVM and Python workers hold about so many bytes at most.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that workers can import it.

    Arrow batches are bounded by bytes from then on unless the session has a bound of its own: texts can be long.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join(os.path.basename(root), os.path.relpath(full, root)))
    path = os.path.join(tempfile.mkdtemp(), "quarry_code.zip")
    with open(path, "wb") as out:
        out.write(buffer.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, uses: object = None) -> DataFrame:
    """``mapInArrow`` with this package on the workers; ``uses`` is the key of the resident that ``fn`` asks for."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began(uses)
        yield from fn(batches)
        trimmed()

    return df.mapInArrow(run, schema)


def group_arrow(groups: GroupedData, fn: Callable[[pa.Table], pa.Table], schema: str | StructType) -> DataFrame:
    """``applyInArrow`` of one group, with the same care for a worker's memory."""

    def run(rows: pa.Table) -> pa.Table:
        began(None)
        return fn(rows)

    return groups.applyInArrow(run, schema)


def cogroup_arrow(left: GroupedData, right: GroupedData, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str | StructType) -> DataFrame:
    """``applyInArrow`` of two groups with one key, with the same care for a worker's memory."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        began(None)
        return fn(a, b)

    return left.cogroup(right).applyInArrow(run, schema)


_TUNED: list[bool] = []


def began(uses: object) -> None:
    """A worker's state before a task: what it freed goes back to the system, and no other stage's resident is left.

    Workers outlive their tasks and take turns, so what each keeps counts several times in an executor's memory.
    """
    if not _TUNED:
        _TUNED.append(True)
        libc = _libc()
        if libc is not None:
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: larger arrays are mappings of their own, unmapped when freed
            libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
            pa.set_memory_pool(pa.system_memory_pool())
    if _RESIDENT and uses not in _RESIDENT:
        _RESIDENT.clear()
        trimmed()


def _libc():
    """The C library, if it is one with glibc's calls."""
    import ctypes

    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt, libc.malloc_trim  # noqa: B018
        return libc
    except (OSError, AttributeError):
        return None


def trimmed() -> None:
    """Give what a worker has freed back to the system."""
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = _libc()
    if libc is not None:
        libc.malloc_trim(0)


_RESIDENT: dict[object, object] = {}


def resident(key: object, make: Callable[[], object]):
    """A worker's one large object (a codec with its memos); tasks that use another, or none, drop it first."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's size: for a file scan the size of its files. No job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions(df: DataFrame, target: int = TARGET_PARTITION_BYTES) -> int:
    """Shuffle partitions that keep each near ``target`` bytes of input, at least the session's own number."""
    return min(1 << 17, portions(df, target))


def portions(df: DataFrame, target: int = TARGET_PARTITION_BYTES) -> int:
    """:func:`partitions` for group keys: their number has no bound, so a group's size has one."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    size = input_bytes(df)
    return max(least, size // target) if size < 1 << 60 else least


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a session whose executors run in the driver's process (as in tests) gets a folder of its
    own; any other raises, since executors would each write to a disk that the others do not see.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    set_by_hand = spark.sparkContext.getCheckpointDir()
    if set_by_hand:
        return set_by_hand
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="quarry-checkpoint-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return own


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder as Parquet and read it back.

    The shuffle files of the plan go as soon as it has been written: nothing else reads them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discarded(df: DataFrame) -> None:
    """Remove a table that :func:`written` made and that no plan reads any more."""
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


# ---------------------------------------------------------------- packed integer arrays


def planes(a: np.ndarray) -> bytes:
    """An array of integers as byte planes, lowest byte first; nearly constant planes compress to nothing."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""


def unplanes(b: bytes, dtype: str) -> np.ndarray:
    """The array that :func:`planes` packed."""
    kind = np.dtype(dtype)
    n = len(b) // kind.itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(kind.itemsize, n).T).reshape(-1).view(kind) if n else np.zeros(0, kind)


# ---------------------------------------------------------------- connected components


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its component) of the graph with edges a-b; at most one per node."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        label = label[label]
        if np.array_equal(label, before):
            break
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy(zero_copy_only=False)])
        b = np.concatenate([b, batch.column(1).to_numpy(zero_copy_only=False)])
        a, b = forest(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): rows (node, component) of every node with an edge.

    The component is its smallest node. Each partition first shrinks its edges to a spanning forest, then
    large-star and small-star steps alternate, each a partial aggregate and a join, until the edges are stars.
    Nothing but one count per round comes to the driver; each round's edges are written to the shared folder.
    Self edges and null ends are dropped.
    """
    spark = edges.sparkSession
    ship(spark)
    clean = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    given = written(clean, "edges")  # what makes the edges may use Python too: a task then has one worker at a time
    now = written(map_arrow(given, _forests, "a long, b long"), "edges")
    discarded(given)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = written(small.where("a <> b").distinct(), "edges")
        # stars: no node is both a centre and a leaf, and no leaf has two centres
        discarded(now)
        loose = after.select(F.col("b").alias("a")).distinct().join(after.select("a"), "a", "left_semi").limit(1).count()
        if not loose and not after.groupBy("a").count().where("count > 1").limit(1).count():
            now = after
            break
        now = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


# ---------------------------------------------------------------- texts by distinct word


def distinct_words(words: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Index of each word into the list of distinct ones."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False).tolist()


def gathered(index: np.ndarray, flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of ``flat`` (``lens`` from ``starts`` on) joined in the order of ``index``, and where each of the groups
    ``offsets`` begins and the last ends."""
    n = lens[index]
    ends = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(starts[index] - ends[:-1], n)
    at += np.arange(ends[-1])
    return flat[at], ends[offsets]


def one_by_one(make: Callable[[str], Sequence[int]]) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """(flat, lens) of what ``make`` gives for each of some words."""

    def many(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        values = list(map(make, words))
        lens = np.fromiter(map(len, values), np.int64, len(values))
        return np.fromiter(itertools.chain.from_iterable(values), np.uint32, int(lens.sum())), lens

    return many


class Known:
    """What ``make`` gives for a word, or ``many`` for some at once, (unsigned 32-bit integers), packed: a word costs 29 bytes and its integers, and
    is known by 128 bits of hash.

    Over ``most`` words those that were not asked for again since the last turn go.
    """

    def __init__(self, make: Callable[[str], Sequence[int]] | None, most: int, many: Callable[[list[str]], tuple[np.ndarray, np.ndarray]] | None = None) -> None:
        self.many, self.most = many or one_by_one(make), most
        self._keep([np.zeros(0, k) for k in (np.uint64, np.uint64, np.int64, np.int32, bool)], np.zeros(0, "<u4"))

    def _keep(self, columns: list[np.ndarray], flat: np.ndarray) -> None:
        self.low, self.high, self.start, self.size, self.asked = columns
        self.flat = flat

    def find(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, starts, lens): the integers of each of some distinct words as slices of one array."""
        hashed = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").astype(np.uint64).reshape(-1, 2)
        low, high = np.ascontiguousarray(hashed[:, 0]), np.ascontiguousarray(hashed[:, 1])
        order = np.argsort(low)
        at = np.empty(len(low), np.int64)
        at[order] = np.searchsorted(self.low, low[order])
        near = np.minimum(at, max(len(self.low) - 1, 0))
        taken = self.low[near] == low if len(self.low) else np.zeros(len(low), bool)
        hit = taken & (self.high[near] == high) if len(self.low) else taken
        starts, lens = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        starts[hit], lens[hit] = self.start[at[hit]], self.size[at[hit]]
        self.asked[at[hit]] = True
        new = np.flatnonzero(~hit)
        values, lens[new] = self.many([words[i] for i in new.tolist()])
        starts[new] = len(self.flat) + np.cumsum(lens[new]) - lens[new]
        flat = np.concatenate([self.flat, values.astype(np.uint32)])
        new = new[~taken[new]]  # a word whose first 64 bits are another's is never kept
        _, first = np.unique(low[new], return_index=True)
        new = new[first]
        added = (low[new], high[new], starts[new], lens[new], np.zeros(len(new), bool))
        self._keep([np.insert(old, at[new], x) for old, x in zip((self.low, self.high, self.start, self.size, self.asked), added)], flat)
        if len(self.low) > self.most:
            self._turn()
        return flat, starts, lens

    def _turn(self) -> None:
        keep = self.asked if self.asked.sum() < self.most // 2 else np.zeros(len(self.asked), bool)
        size = self.size[keep].astype(np.int64)
        flat, ends = gathered(np.arange(len(size)), self.flat, self.start[keep], size, np.arange(len(size) + 1))
        self._keep([self.low[keep], self.high[keep], ends[:-1], size.astype(np.int32), np.zeros(len(size), bool)], flat)


class Memo(dict):
    """A dict that computes what it lacks; :meth:`bounded` forgets what was not asked for lately."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make
        self.before: dict = {}

    def __missing__(self, key):
        value = self.before[key] if key in self.before else self.make(key)
        self[key] = value
        return value

    def bounded(self, most: int) -> None:
        """Keep at most about ``most`` entries: half of them from before the last turn."""
        if len(self) > most // 2:
            self.before = dict(self)
            self.clear()
