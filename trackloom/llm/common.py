"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import operator
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII upper case to lower case, as a table for bytes.translate.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Text bytes that a Python step works on at once; a longer single text is a piece of its own.
PIECE_BYTES = 4 << 20
#: Bytes of an Arrow batch.
BATCH_BYTES = 4 << 20
#: Narrow rows of a part of what is stored, where their number is known.
PART_ROWS = 250_000


def small_batches(spark: SparkSession) -> None:
    """From now on whole texts go to Python workers a few MB at a time, not 64, unless the session says otherwise."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where that is unset on a local master (tests, one machine) a temporary folder is made and set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if at:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(at)
        return at
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="trackloom-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        context.setCheckpointDir(f"file://{local}")
    return context.getCheckpointDir()


#: Folders made within scratch(), of this thread's innermost one.
_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def new_folder(spark: SparkSession, name: str) -> str:
    folder = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(folder)
    return folder


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the folders that new_folder() named within: what was read from them must be written by then."""
    token = _made.set([])
    try:
        yield
    finally:
        folders = _made.get()
        _made.reset(token)
        for folder in folders:
            remove(spark, folder)


def in_parts(df: DataFrame, rows: int | None) -> DataFrame:
    """df in as few partitions as so many rows need, one for each core at least; as it is without a number.

    Where files are on a local disk, Hadoop starts a process for each that is made, so hundreds of
    partitions of a few rows are hundreds of processes.
    """
    return df if rows is None else df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS)))


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows of df from the shared checkpoint folder, without lineage. rows: how many there are at most, if that is known."""
    shared_dir(df.sparkSession)
    return in_parts(df, rows).checkpoint(eager=True)


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """The rows of df from a table in the shared folder, without lineage: smaller than cut() for many rows or wide ones, read by column."""
    folder = new_folder(df.sparkSession, name)
    in_parts(df, rows).write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def parts_counted(text: Column, gap: str) -> Column:
    """How many parts of text the gaps (a pattern of one and more characters) leave; 0 for null. Far cheaper than to count matches."""
    parts = F.split(text, gap)
    ends = (F.get(parts, F.lit(0)) == "").cast("long") + ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("long")
    return F.coalesce(F.size(parts) - ends, F.lit(0)).cast("long")


def crc_mod(doc_id: str, divisor: int) -> Column:
    """crc32 of doc_id as text, mod divisor."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def settle() -> None:
    """Gives back to the system what numpy and Arrow freed: workers live on after a task, next to those of others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about limit text bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at, _ = utf8(batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
            yield batch.slice(first, last - first)
            first = last
    settle()


def lists(offsets: np.ndarray, data: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def join_hot(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """rows joined with names (one row a key) on key, without meeting the rows of a frequent key in one task.

    Keys with over a thousandth of the rows, of which there are fewer than a thousand, are joined by
    broadcast, the others by a shuffle. Null keys are left out.
    """
    size = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = size.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_all"))
    hot = cut(size.join(F.broadcast(total)).where("_n * 1000 > _all AND _n > 1000").select(key))
    named = F.broadcast(names.join(F.broadcast(hot), key, "left_semi"))
    return rows.join(named, key).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(names, key))


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate results, in whatever store it is."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: The bits of a row's number in its partition in what ordered() numbers.
ROW_BITS = 33


def ordered(rows: DataFrame, by: list[str], keep: list[str], name: str) -> DataFrame:
    """The columns keep of rows with seq: numbers that rise in the order of the columns by, written once.

    Rows are sorted in ranges, and a number begins with that of its range: nothing is counted, and no group
    meets in one task. Rows alike in all columns by are dealt to ranges too, in an arbitrary order.
    """
    ranges = rows.withColumn("_any", F.rand(7)).repartitionByRange(*by, "_any").sortWithinPartitions(*by, "_any")
    return written(ranges.select(*keep, F.monotonically_increasing_id().alias("seq")), name)


def running(rows: DataFrame, group: list[str], sums: dict[str, Column], total: Callable[[Column], Column] = F.sum, add: Callable[[Column, Column], Column] = operator.add) -> DataFrame:
    """rows (of ordered()) with, for each name of sums, that expression's total over the rows of its group up to itself.

    Totals are made range by range and set off by those of the ranges before, which are as many as there
    are ranges and groups in them. total and add: a sum, or another operation of that kind with zero 0.
    """
    rows = rows.withColumns({f"_v_{k}": v for k, v in sums.items()} | {"_range": F.shiftright("seq", ROW_BITS)})
    totals = rows.groupBy(*group, "_range").agg(*[total(F.col(f"_v_{k}")).alias(f"_t_{k}") for k in sums])
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "_range", *[F.coalesce(total(F.col(f"_t_{k}")).over(before), F.lit(0)).alias(f"_o_{k}") for k in sums])
    own = Window.partitionBy(*group, "_range").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({k: total(F.col(f"_v_{k}")).over(own) for k in sums}).join(offsets, [*group, "_range"])
    return out.withColumns({k: add(F.col(k), F.col(f"_o_{k}")) for k in sums}).drop("_range", *[f"_{p}_{k}" for p in "vo" for k in sums])
