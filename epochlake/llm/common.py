"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import itertools
import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of text that a Python worker holds as word lists at once.
SLICE_BYTES = 2 << 20
#: Words whose hashes a Python worker remembers.
CACHE_WORDS = 200_000
#: Keys that are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 200_000
#: Rows of one key beyond which it isn't joined by a shuffle.
HOT_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir; one of our own where that is unset and all is on one machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if named:
        if current is None:
            sc.setCheckpointDir(named)
        return named
    if current is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="epochlake-"))
    return sc.getCheckpointDir()


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any store, if it is there."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles and checkpoints that nothing refers to any more: it does so when the driver's heaps are collected."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Tables that are written before the ones that nothing needs any more are swept away.
SWEEP_EVERY = 2
_written = itertools.count(1)


def persist(df: DataFrame, eager: bool = True) -> DataFrame:
    """df, written to the shared folder and cut from its lineage."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager)
    if next(_written) % SWEEP_EVERY == 0:
        sweep(df.sparkSession)
    return out


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df doesn't have, without regard to case, one for each stem."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name, n = stem, 0
        while name.lower() in taken:
            n += 1
            name = f"{stem}_{n}"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about `most` bytes of the column, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.nan_to_num(pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype("f8"))
        group = (np.cumsum(lengths) // most).astype("i8")
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of `width` words inside each text, texts one after another, and their number in each text.

    A text of fewer words has one shingle, its whole sequence; a text without words has none.
    """
    starts = np.concatenate(([0], np.cumsum(counts)))
    out_counts = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    h = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
    mult = np.uint64(0x9E3779B97F4A7C15)
    for j in range(width):
        h *= mult
        h += words[j : j + len(h)]
    full = counts >= width
    out = np.empty(int(out_counts.sum()), dtype=np.uint64)
    out_starts = np.concatenate(([0], np.cumsum(out_counts)))
    take = np.repeat(starts[:-1] - out_starts[:-1], out_counts) + np.arange(len(out))
    long_mask = np.repeat(full, out_counts)
    out[long_mask] = h[take[long_mask]]
    for i in np.flatnonzero(~full & (counts > 0)):
        v = 0
        for w in words[starts[i] : starts[i + 1]].tolist():
            v = (v * int(mult) + w) & 0xFFFFFFFFFFFFFFFF
        out[out_starts[i]] = (v + int(counts[i]) * 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF
    return mix64(out), out_counts


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running(df: DataFrame, key: str, order: list[str], weight: str, out: str, buckets: int) -> DataFrame:
    """df with column `out`: the sum of `weight` over the rows of the same key that come before, in a fixed order.

    The order is by hash bucket of the `order` columns, then by these columns, so that a key with a third of all rows is
    dealt to `buckets` groups. Sums by key and bucket are aggregated before they are shuffled. A key may be null. Rows equal
    in all of `order` come in any order.
    """
    b, base = "_bucket", "_base"
    rows = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sums = rows.groupBy(key, b).agg(F.sum(weight).alias("_sum"))
    before = Window.partitionBy(key).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(key).alias("_key"), F.col(b).alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias(base))
    inside = Window.partitionBy(key, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # dealt anew: rows that lie by their key alone would satisfy the window, too, with one task for a hot key
    local = rows.repartition(key, b).withColumn(out, F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    joined = local.join(sums, F.col(key).eqNullSafe(F.col("_key")) & (F.col(b) == F.col("_b")), "left")
    return joined.withColumn(out, F.col(out) + F.col(base)).drop(b, base, "_key", "_b")


def join_hot(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left joined with right(key, ...), which has at most one row a key: keys with over HOT_ROWS rows of left go by a broadcast.

    left must be at rest. There are at most count / HOT_ROWS such keys; should even these be too many, they are shuffled too.
    """
    hot = persist(left.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > HOT_ROWS).select(key))
    n = hot.count()
    if not n or n > BROADCAST_KEYS:
        return left.join(right, key)
    hot = F.broadcast(hot)
    few = right.join(hot, key, "left_semi")
    return left.join(hot, key, "left_anti").join(right, key).unionByName(left.join(F.broadcast(few), key))


def column(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def attach(docs: DataFrame, rows: DataFrame, keys: dict[str, Column], many: DataFrame) -> DataFrame:
    """(row, payload): the columns of docs as a struct, with the payload of one of rows(*keys, payload) that has the same keys.

    keys names columns of rows and says what of docs they are compared with; null equals null. many(*keys) has the keys that
    several rows of docs share: there each row takes another one of rows, in the order of the hashes of both, and rows of docs
    for which none is left are dropped, as those whose keys rows doesn't have are. Which of several rows alike in all columns
    takes which is not fixed. Where one key is most of docs, only rows with equal hashes are numbered by one task.
    """
    names = list(keys)
    left = docs.select(F.struct(*map(column, docs.columns)).alias("row"), *(c.alias(k) for k, c in keys.items()))
    right = rows.select(*(F.col(k).alias(f"_{k}") for k in names), "payload")
    many = persist(many.select(*(F.col(k).alias(f"many_{k}") for k in names)))
    hint = F.broadcast if many.count() <= BROADCAST_KEYS else lambda x: x

    def same(prefix: str, other: str) -> Column:
        out = F.lit(True)
        for k in names:
            out = out & F.col(prefix + k).eqNullSafe(F.col(other + k))
        return out

    # rows has about as many rows as docs: never to be broadcast, whatever its size is thought to be
    single = left.join(hint(many), same("", "many_"), "left_anti").join(right.join(hint(many), same("_", "many_"), "left_anti").hint("merge"), same("", "_"))
    if many.isEmpty():
        return single.select("row", "payload")

    def numbered(df: DataFrame, prefix: str, by: str) -> DataFrame:
        held = df.join(hint(many), same(prefix, "many_"), "left_semi").withColumns({"one": F.lit(1).cast("long"), "tie": F.xxhash64(by)})
        held = held.withColumn("group", F.struct(*(F.col(prefix + k) for k in names)))
        return running(held, "group", ["tie"], "one", f"{by}_nth", 64).drop("one", "tie", "group")

    several = numbered(left, "", "row").join(numbered(right, "_", "payload"), same("", "_") & (F.col("row_nth") == F.col("payload_nth")))
    return single.select("row", "payload").unionByName(several.select("row", "payload"))


@lru_cache(maxsize=1)
def one_thread() -> None:
    """Numpy's matrix products use one thread from now on: a task has one core, and idle threads of the library spin."""
    import ctypes
    from pathlib import Path

    for path in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        blas = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(blas, name):
                getattr(blas, name)(1)
                break


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run on one thread, after which the Python process gives back the memory that the task took, as it lives on for later stages."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return tidied
