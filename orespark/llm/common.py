"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .. import session
from ..session import shared_dir

#: Text that one step of a Python worker holds at once, and bytes of a batch that passes to it.
SLICE_BYTES, BATCH_BYTES = 2 << 20, 8 << 20
#: Rows of a narrow table that go to a file, where their number is known.
ROWS_A_FILE = 250_000
#: Rows of one key that a task gets before the key is spread over several, and keys that can be spread at once: a key with
#: more than 1 / MOST_HEAVY of all rows is one of MOST_HEAVY at most, so the list of them has a fixed size.
SPREAD_ROWS, MOST_HEAVY = 1000, 1 << 14
#: The part of its heap that the driver's JVM may have taken when a table is written down, before it collects its garbage.
DRIVER_TAKEN = 0.25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths that materialize() has written since the innermost scratch() began.
_written: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("written", default=None)


def write_down(df: DataFrame, name: str, rows: int | None = None) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and the table's own folder. ``rows``, if it is known, sets how many files there are at
    most."""
    folder = f"{shared_dir(df.sparkSession)}/orespark/{uuid.uuid4().hex}"
    path = f"{folder}/{name}"
    (df if rows is None else df.coalesce(1 + rows // ROWS_A_FILE)).write.parquet(path)
    relieve_driver(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path), folder


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df down and read it again: lineage ends here, and lost executors cost nothing. The table stays until a scratch()
    around the call ends, or its folder is deleted."""
    table, folder = write_down(df, name, rows)
    if (made := _written.get()) is not None:
        made.append(folder)
    return table


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that materialize() writes inside are deleted at the end. What is to outlast it must be written outside."""
    token = _written.set(made := [])
    try:
        yield
    finally:
        _written.reset(token)
        for path in made:
            delete(spark, path)


class Held:
    """Frames that an operator keeps on the executors' disks while it works, and lets go at its end. Lineage stays, so what is
    lost with an executor is made again."""

    def __init__(self):
        self.frames: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.frames.append(df.persist(StorageLevel.DISK_ONLY))
        return df

    def __enter__(self):
        return self

    def __exit__(self, *_):
        for df in self.frames:
            df.unpersist()


def settle(df: DataFrame, name: str) -> DataFrame:
    """df as a table of few files, made by as many tasks as it has partitions."""
    with Held() as hold:
        return materialize(hold(df), name, df.count())


def heavy_keys(counts: DataFrame, on: list[str], rows: str, total: int, least: int | None = None) -> DataFrame | None:
    """The keys of counts (on, rows) that stand in so many of all ``total`` rows that they are spread, over ``least`` (SPREAD_ROWS)
    at least, with the number of parts; None if there is no such key. counts is read twice: a table or a held frame."""
    limit = max(least or SPREAD_ROWS, total // MOST_HEAVY)
    heavy = counts.where(F.col(rows) > limit).select(*on, F.ceil(F.col(rows) / limit).cast("int").alias("_parts"))
    return None if heavy.isEmpty() else heavy


def salted_join(left: DataFrame, right: DataFrame, on: list[str], heavy: DataFrame | None, by: str, how: str = "left") -> DataFrame:
    """left joined with right on equal keys, with the heavy ones of left's rows dealt out by the column ``by`` and right's rows
    sent to all their parts. how="inner" if all of left's keys are heavy: other rows of right stay where they are."""
    if heavy is None:
        return left.join(right, on)
    parts = F.col("_parts")
    dealt = left.join(F.broadcast(heavy), on, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), parts).cast("int"), F.lit(0))).drop("_parts")
    copies = right.join(F.broadcast(heavy), on, how).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copies, [*on, "_salt"]).drop("_salt")


def fresh(name: str, *taken: Iterable[str]) -> str:
    """A column name, beginning with this one, that no list holds, whatever the case."""
    used = {c.lower() for names in taken for c in names}
    while name.lower() in used:
        name += "_"
    return name


def integer_id(docs: DataFrame, id_col: str) -> None:
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must hold integers, it holds {docs.schema[id_col].dataType.simpleString()}")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds what passes to a Python worker at once, by rows and by bytes, for texts may be long; both sides of the pipe hold
    such a batch. The settings are the session's and are read when a result is, so they stay; smaller ones are left alone."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name).removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


def sampled(hashes: DataFrame, n: int) -> int | None:
    """The n-th lowest of the different values of a column of hashes (the highest, if there are fewer), None if there is none.
    Only a part of them that is likely to hold n is gathered first, then a larger one."""
    column = F.col(hashes.columns[0])
    total, share = hashes.count(), 0.0
    while total and share < 1:
        share = min(1.0, share * 16 or 4 * n / total)
        below = hashes.where(column <= min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))).distinct()
        top = below.orderBy(column).limit(n).agg(F.max(column), F.count(column)).first()
        if top[1] >= n or share >= 1:
            return top[0]
    return None


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def give_back() -> None:
    """Return to the system what this process has freed: workers outlive their tasks, and allocators keep freed memory."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc has it
        trim(0)


def relieve_driver(spark: SparkSession) -> None:
    """Let the driver's JVM collect its garbage, if more than DRIVER_TAKEN of its heap is taken."""
    session.relieve_driver(spark, DRIVER_TAKEN)


def collect_garbage(spark: SparkSession) -> None:
    """Let the executors' JVMs, and the driver's, collect their garbage and return the heap that is free then. A JVM keeps what it
    once took, and the Python workers beside it need that memory."""
    relieve_driver(spark)
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc')").collect()


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


class Kept(dict):
    """Results of ``make`` by key. When there are MOST, those of the generation before go, so what comes again and again
    stays and memory is bounded."""

    MOST = 100_000

    def __init__(self):
        self.old: dict = {}

    def make(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.MOST:
            self.old = self.copy()
            self.clear()
        self[key] = value
        return value


class Seen:
    """Tells keys that are new from those met before. Of the latter the last MOST to 2 * MOST are known; an older one counts as
    new again."""

    MOST = 100_000

    def __init__(self):
        self.now: set = set()
        self.before: set = set()

    def is_new(self, key) -> bool:
        if key in self.now:
            return False
        if len(self.now) >= self.MOST:
            self.now, self.before = set(), self.now
        self.now.add(key)
        return key not in self.before


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Bloom:
    """A bit set of fixed size over 64-bit numbers: members are always found, others seldom."""

    PROBES = 4

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def parts(self) -> tuple[int, np.ndarray]:
        """What is broadcast: plain values, from which an executor makes the filter again."""
        return self.bits, self.words

    @staticmethod
    def places(values: np.ndarray, bits: int) -> list[np.ndarray]:
        h = mix64(values)
        a, b = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
        return [(a + np.uint64(i) * b) & np.uint64(bits - 1) for i in range(Bloom.PROBES)]

    def has(self, values: np.ndarray) -> np.ndarray:
        found = np.ones(len(values), bool)
        if not self.words.any():
            return ~found
        for place in self.places(values, self.bits):
            found &= (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return found


def bloom(df: DataFrame, column: str, expected: int, most_bits: int = 1 << 26) -> Bloom:
    """The Bloom filter of a long column. Its size, at most ``most_bits`` (8 MB), is all that reaches the driver."""
    bits = 1 << 12
    while bits < min(16 * expected, most_bits):
        bits *= 2

    def places(batches):
        for batch in batches:
            values = np.unique(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)).view(np.uint64)
            every = np.concatenate(Bloom.places(values, bits)) if len(values) else np.zeros(0, np.uint64)
            word, place = (every >> np.uint64(6)).astype(np.int64), np.uint64(1) << (every & np.uint64(63))
            order = np.argsort(word, kind="stable")
            word, place = word[order], place[order]
            first = np.flatnonzero(np.diff(word, prepend=-1))
            masks = np.bitwise_or.reduceat(place, first) if len(first) else place
            yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(masks.view(np.int64))], names=["word", "mask"])

    found = df.select(F.col(column).cast("long").alias("v")).where("v is not null").mapInArrow(places, "word long, mask long")
    got = found.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[got.column("word").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
    return Bloom(bits, words)


def summed_arrays(df: DataFrame, mapper, names: dict[str, int], pieces: int = 64) -> dict[str, np.ndarray]:
    """Sums of arrays of fixed length that ``mapper`` counts in each partition.

    ``mapper(batches)`` yields (name, int64 array) pairs; names maps each name to its length. The arrays are cut into
    pieces, added up in two rounds, so that no task gets more than a share of the partitions' pieces, and only the sums,
    whose size is fixed, reach the driver.
    """

    def cut(batches):
        salt = TaskContext.get().partitionId() % 32  # the same again when a lost task is run anew
        for name, values in mapper(batches):
            size = -(-len(values) // pieces)
            parts = [values[k : k + size].astype(np.int64) for k in range(0, len(values), size)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array([salt] * len(parts), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["name", "piece", "salt", "part"]
            )

    def add(got: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in got.column("part"))
        return pa.table({"name": got.column("name")[:1], "piece": got.column("piece")[:1], "salt": pa.array([0], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})

    kind = "name string, piece int, salt int, part binary"
    parts = df.mapInArrow(cut, kind)
    once = parts.groupBy("name", "piece", "salt").applyInArrow(add, kind)
    out = {k: np.zeros(n, np.int64) for k, n in names.items()}
    for row in once.groupBy("name", "piece").applyInArrow(add, kind).select("name", "piece", "part").collect():
        size = -(-len(out[row.name]) // pieces)
        part = np.frombuffer(row.part, np.int64)
        out[row.name][row.piece * size : row.piece * size + len(part)] = part
    return out
