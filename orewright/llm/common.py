"""Shared tools of the text operators: scratch tables in the shared folder, row numbers, Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only for a local master whose session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="orewright-")
        atexit.register(_remove_local, _OWN_DIRS[app])
    return "file://" + _OWN_DIRS[app]


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def sweep(spark: SparkSession) -> None:
    """Removes all tables that this application's operators wrote, once their results have been used."""
    _delete(spark, f"{shared_dir(spark)}/orewright-{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


_MADE: list[str] = []


def tables_made() -> int:
    return len(_MADE)


def drop_since(spark: SparkSession, first: int, *keep: DataFrame) -> None:
    """Removes the tables written after ``tables_made`` gave ``first``, but for those that ``keep`` reads."""
    kept = {f.rsplit("/", 1)[0].split("orewright-", 1)[-1] for df in keep for f in df.inputFiles()}
    for path in _MADE[first:]:
        if path.split("orewright-", 1)[-1] not in kept:
            _delete(spark, path)
    _MADE[first:] = [p for p in _MADE[first:] if p.split("orewright-", 1)[-1] in kept]


class Scratch:
    """Tables written to the shared folder to cut lineage: a lost executor never forces the work before them again.

    ``save`` writes and rereads; ``drop`` removes a table that later steps no longer read. What a result still depends on
    stays until ``sweep``.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/orewright-{spark.sparkContext.applicationId}"
        self._paths: dict[int, tuple[DataFrame, str]] = {}
        self._kept: set[int] = set()

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        _MADE.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (out, path)
        return out

    @contextlib.contextmanager
    def passing(self) -> Iterator[None]:
        """Drops at its end what was saved within, but for tables named to ``keep``."""
        before, self._kept = set(self._paths), set()
        yield
        self.drop(*[df for k, (df, _) in list(self._paths.items()) if k not in before and k not in self._kept])

    def keep(self, *tables: DataFrame) -> None:
        self._kept |= {id(t) for t in tables}

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            _, path = self._paths.pop(id(df), (None, None))
            if path:
                _delete(self.spark, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names; all others are pruned at the scan."""
    return df.select(*[df[c].alias(name) for name, c in columns.items()])


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The values of a string column as bytes, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def dense_rank_in(df: DataFrame, key: Column, order: list[Column], name: str, rows_per_bucket: int = 50_000, rows: int | None = None) -> DataFrame:
    """Numbers the rows of each key from 0 without gaps, for a key of few values, without one task per key.

    Rows fall into hash buckets of the order columns; a window numbers each (key, bucket), and running
    totals over the bucket counts (one row a bucket and key) give each bucket's start.
    """
    spark = df.sparkSession
    rows = df.count() if rows is None else rows
    buckets = max(1, rows // rows_per_bucket + 1)
    k, b, start, n = (f"__{name}_{x}" for x in ("key", "bucket", "start", "n"))
    keyed = df.withColumn(k, key).withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy(k, b).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(k).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(k), F.col(b), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    inside = F.row_number().over(Window.partitionBy(k, b).orderBy(*order)) - 1
    left = keyed.withColumn(name, inside.cast("long"))
    sk, sb = starts[k].alias("__sk"), starts[b].alias("__sb")
    joined = left.join(starts.select(sk, sb, start), F.col(k).eqNullSafe(F.col("__sk")) & (F.col(b) == F.col("__sb")), "left")
    return joined.withColumn(name, F.col(name) + F.col(start)).drop(k, b, start, "__sk", "__sb")


def slices(batches: Iterable[pa.RecordBatch], size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches, cut into parts of about ``size`` bytes (of one row at least), so that what is made of a part is bounded."""
    for batch in batches:
        rows = max(1, min(batch.num_rows, batch.num_rows * size // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_settled = False


def _settle_memory() -> None:
    """Makes this worker return large arrays to the system as soon as they are freed, those of Arrow too.

    Workers live on and share the memory of their executor, so what one task has freed must not stay with its worker.
    """
    global _settled
    if not _settled:
        _settled = True
        pa.set_memory_pool(pa.system_memory_pool())
        with contextlib.suppress(OSError, AttributeError):
            libc = ctypes.CDLL(None)
            libc.mallopt(-3, 4 << 20)  # arrays from 4 MB on are mapped by themselves, and stay so
            libc.mallopt(-1, 32 << 20)  # the heap's end is given back from 32 MB on


class tidy:  # noqa: N801
    """An Arrow function that gives freed memory back, at the end of each task at the latest."""

    def __init__(self, function: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]):
        self.function = function

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _settle_memory()
        yield from self.function(slices(batches))
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


class Forest:
    """Minimum-label union over local row numbers; ``link`` returns only the edges that joined two trees."""

    def __init__(self, labels: np.ndarray):
        self.labels = labels

    def link(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high, low = [], []
        while len(a):
            x, y = self.labels[a], self.labels[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            up = np.arange(len(self.labels))
            top = np.maximum(x, y)
            np.minimum.at(up, top, np.minimum(x, y))
            moved = np.unique(top)
            high.append(moved)
            low.append(up[moved])
            while not np.array_equal(up, nxt := up[up]):
                up = nxt
            self.labels = up[self.labels]
        none = np.zeros(0, dtype=np.int64)
        return (np.concatenate(high), np.concatenate(low)) if high else (none, none)
