"""Shared helpers: table reading, shared storage, and vectorised word and shingle hashing."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Where intermediate tables go when a local session (tests) names no shared folder. On a cluster there is no such place.
LOCAL_SHARED = "file:///tmp/checkpoints"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder URI under the folder that the cluster shares (spark.checkpoint.dir)."""
    ship(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_SHARED
    return f"{base.rstrip('/')}/loom-{tag}-{uuid.uuid4().hex[:12]}"


#: With it Spark drops an execution's shuffle files when the execution ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and reread it; the shuffle files of the write go with it."""
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.loom_path = path
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what is written inside: for rows that hold kilobytes each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote, once everything that was read from them is written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.loom_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


MAX_BUCKETS = 100_000


def input_bytes(df: DataFrame, text: str = "text") -> int:
    """About how many bytes a table takes: Spark's estimate for files, which costs no job, else the measured text."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < 1 << 50:
        return size
    return int(df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]) // 2


def buckets_for(df: DataFrame, each_mb: float) -> int:
    """Number of hash buckets so that each holds about ``each_mb`` of the input; grows with the input."""
    return min(MAX_BUCKETS, max(32, int(input_bytes(df) / (each_mb * 1e6)) + 1))


def tidy() -> None:
    """Give memory that a task no longer needs back to the system: Python workers live on and serve later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


# ---------------------------------------------------------------- bytes of an Arrow batch


def text_slices(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str, max_bytes: int = 1_500_000) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Yield (ids, bytes, offsets) for runs of rows of about ``max_bytes`` of UTF-8 text (one longer text comes alone). Null texts are empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text_col)).cast(pa.large_string())
        if col.null_count:
            col = col.fill_null("")
        offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
        raw = col.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        ids = batch.column(batch.schema.get_field_index(id_col)).to_pylist()
        lo = 0
        while lo < len(ids):
            hi = int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1
            hi = min(len(ids), max(hi, lo + 1))
            yield ids[lo:hi], data[offs[lo] : offs[hi]], (offs[lo : hi + 1] - offs[lo]).astype(np.int64)
            lo = hi
        del col, data, raw, batch
    tidy()


# ---------------------------------------------------------------- hashing

_M = np.uint64(0x9E3779B97F4A7C15 | 1)
_MINV = np.uint64(pow(int(_M), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, vectorised."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def byte_values() -> np.ndarray:
    """A 64-bit value per byte; capital ASCII letters share the value of their small letter."""
    v = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    v[65:91] = v[97:123]
    return v


def _pow(base: np.uint64, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.empty(size, np.uint64)
        out[0] = 1
        done = 1
        step = base
        while done < size:  # doubling: out[done:2*done] = out[:done] * base**done
            m = min(done, size - done)
            out[done : done + m] = out[:m] * step
            done += m
            step = np.uint64(int(step) ** 2 & (1 << 64) - 1)
        have = _powers[name] = out
        if size > 8_000_000:
            _powers.pop(name)
    return have[:n]


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(C, inverse powers): the hash of data[a:b] is (C[b] - C[a]) * inverse[a], equal for equal bytes (ASCII case aside)."""
    n = len(data)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(byte_values()[data] * _pow(_M, n, "m"), out=c[1:])
    return c, _pow(_MINV, n + 1, "i")


WORD_ALNUM = np.zeros(256, bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z
WORD_ALNUM[48:58] = WORD_ALNUM[65:91] = WORD_ALNUM[97:123] = True
WORD_ALNUM[128:] = True
WORD_SPACED = np.ones(256, bool)  # [^\x20\x09-\x0D]
WORD_SPACED[[32, 9, 10, 11, 12, 13]] = False


def words_of(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word index of each row and the total at the end) of the words of every row; no word crosses rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    w = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.empty_like(w)
    before[0] = False
    before[1:] = w[:-1]
    starts = np.flatnonzero(w & (~before | edge[:-1]))
    after = np.empty_like(w)
    after[-1] = False
    after[:-1] = w[1:]
    ends = np.flatnonzero(w & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, ASCII case aside."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    c, inv = prefix_hash(data)
    return mix64((c[ends] - c[starts]) * inv[starts])


_SHINGLE = [np.uint64(pow(0xC2B2AE3D27D4EB4F | 1, k + 1, 1 << 64)) for k in range(64)]


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = 5, table: np.ndarray = WORD_SPACED) -> Iterator[np.ndarray]:
    """For each row, the sorted distinct 64-bit hashes of its k-word shingles; fewer words make one shingle, none make none."""
    starts, ends, first = words_of(data, offs, table)
    h = word_hashes(data, starts, ends)
    n = len(h)
    acc = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        acc += h[j : n - k + 1 + j] * _SHINGLE[j] if n >= k else acc
    acc = mix64(acc)
    for r in range(len(offs) - 1):
        a, b = int(first[r]), int(first[r + 1])
        if b - a >= k:
            yield np.unique(acc[a : b - k + 1])
        elif b > a:
            s = np.uint64(0)
            with np.errstate(over="ignore"):
                for j in range(b - a):
                    s = s + h[a + j] * _SHINGLE[j]
                yield mix64(np.array([s + np.uint64((b - a) * 0x9E3779B9)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


# ---------------------------------------------------------------- joins with hot keys

#: A key with more rows than this and than this share of all rows is hot, so there are at most 1 / HOT_SHARE hot keys.
HOT_ROWS = 256
HOT_SHARE = 1 / 1000


def join_hot(many: DataFrame, one: DataFrame, on: list[str], rows: str, total: int) -> DataFrame:
    """Inner join of ``many`` with ``one`` (a row per key; its column ``rows`` counts the key's rows in ``many``, ``total`` in sum).

    Hot keys are dealt: their rows in ``many`` get a salt, their row in ``one`` is repeated for every salt. The hot keys
    are broadcast; no more than 1 / HOT_SHARE keys can be hot, so the size of that table is bounded by its definition.
    """
    limit = max(HOT_ROWS, int(total * HOT_SHARE))
    salts = F.ceil(F.col(rows) / limit).cast("int")
    hot = F.broadcast(one.filter(F.col(rows) > limit).select(*on, salts.alias("_salts")))
    dealt = many.join(hot, on, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*many.columns), F.col("_salts"))).cast("int")).drop("_salts")
    spread = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col(rows) > limit, salts - 1).otherwise(0))))
    return dealt.join(spread, [*on, "_salt"]).drop("_salt")


# ---------------------------------------------------------------- connected components


def _mark(edges: DataFrame) -> tuple:
    """What tells two sets of undirected edges apart: their number and two folds of their hashes, in one pass."""
    h = F.xxhash64(F.least("a", "b"), F.greatest("a", "b"))
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftright(h, 24))).first())


def components(edges: DataFrame, tag: str = "cc", rounds: int = 100) -> DataFrame:
    """Distributed union-find over edges(a, b): rows (node, component) with the smallest node of each component, for every node of an edge.

    Alternates hooking (each node's parent becomes the smallest parent among its neighbours) with pointer
    jumping; every round is a few joins keyed by node, written to the shared folder, so nothing is gathered on the driver.
    The rounds needed grow with the logarithm of the longest chain, so their bound is only a guard against a fault.
    """
    edges = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = materialize(edges, f"{tag}-edges")
    mark = _mark(edges)
    for i in range(rounds):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("degree"))
        # large star: larger neighbours hook on the smallest; small star: smaller ones too. A hub's edges are dealt
        large = join_hot(both, least, ["a"], "degree", 2 * mark[0]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialize(large, f"{tag}-l{i}")
        mins = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(mins, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(mins.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        small = materialize(small, f"{tag}-s{i}")
        discard(edges, large)
        before, mark, edges = mark, _mark(small), small
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    out = edges.groupBy("a").agg(F.min("b").alias("component"))
    roots = edges.select("b").distinct().withColumnRenamed("b", "node").join(out.select(F.col("a").alias("node")), "node", "left_anti")
    return out.withColumnRenamed("a", "node").union(roots.select("node", F.col("node").alias("component")))
