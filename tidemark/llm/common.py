"""What the operators of this subpackage share: the shared scratch folder, table writes that cut
lineage, and row-batch helpers for the Arrow operators."""

from __future__ import annotations

import atexit
import contextlib
import gc
import itertools
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that an Arrow operator works on at once: keeps what it makes of long texts small beside the executor's memory.
BATCH_ROWS = 512
#: Parts that the rows of one key are dealt to where a key may hold a large share of all rows.
SALTS = 64

#: The scratch folder of each table that ``saved`` gave.
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a local session gets one of its own;
    on a cluster that is an error, as executors would each write to a disk of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def goes_at_exit(spark: SparkSession, path: str) -> None:
    """What is at ``path`` is removed when the application ends."""
    store, at = _stored(spark, path)
    store.deleteOnExit(at)


def _stored(spark: SparkSession, path: str) -> tuple[Any, Any]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_ROWS rows at most while a table is written; then the session's own setting again."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, own)


def saved(df: DataFrame, name: str, instead_of: Iterable[DataFrame] = ()) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: later plans start at files
    that outlive any executor, and every reader sees the same rows in the same partitions. Then the saved tables
    ``instead_of``, which nothing reads any more, are removed; the others go when the application ends."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    with _small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    goes_at_exit(spark, path)
    for old in instead_of:
        store, at = _stored(spark, _folders.pop(old))
        store.delete(at, True)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def shuffles_end(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of frames that nothing refers to any more: it does when the driver's objects
    for them are collected, which may otherwise take long."""
    gc.collect()
    spark._jvm.System.gc()


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row a ``key``, where a key may hold a large share of ``rows``: these are dealt
    to SALTS parts by their column ``by``, each (key, part) that there is fetches the key's row first, and the rows then
    join on both. ``key`` is not null on either side."""
    salt = free_name(rows, "_salt")
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(SALTS)))
    known = dealt.select(key, salt).distinct().join(keyed, key)
    return dealt.join(known, [key, salt], how).drop(salt)


def row_numbers(seen: list[int], rows: int) -> pa.Array:
    """Numbers that no other row of the same job has: the task's partition above, its rows so far below.
    ``seen`` is the task's own counter."""
    first = (TaskContext.get().partitionId() << 36) + seen[0]
    seen[0] += rows
    return pa.array(range(first, first + rows), pa.int64())


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` over batches of BATCH_ROWS rows at most, for columns of any name: Spark's own takes a dot in a name for a
    field's, and its batches hold up to ``spark.sql.execution.arrow.maxBytesPerBatch``."""
    names = df.columns
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    plain = T.StructType([T.StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(out)])

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = (pa.RecordBatch.from_arrays(b.slice(k, BATCH_ROWS).columns, names) for b in batches for k in range(0, b.num_rows, BATCH_ROWS))
        for batch in run(small):
            yield pa.RecordBatch.from_arrays(batch.columns, plain.names)

    return df.toDF(*[f"c{k}" for k in range(len(names))]).mapInArrow(renamed, plain).toDF(*out.names)


def arrow_map(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType | str) -> DataFrame:
    """``mapped`` with a function of one batch."""
    return mapped(df, lambda batches: map(make, batches), schema)


def column_bytes(batch: pa.RecordBatch, at: int) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]


def column_texts(batch: pa.RecordBatch, at: int) -> list[str]:
    """A string column as Python strings, null as empty."""
    return [x or "" for x in batch.column(at).to_pylist()]


def named(columns: list[str]) -> list[Column]:
    """The columns by their exact names, dots included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in itertools.chain([stem], (f"{stem}_{k}" for k in itertools.count(1))) if n.lower() not in taken)
