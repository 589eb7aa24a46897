"""Shared pieces of the operators: stored intermediate tables and Arrow batches in bounded slices."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldledger.session import fresh_dir

# Bytes of text that one slice of an Arrow batch holds at most, unless a single text is longer.
SLICE_BYTES = 1 << 18


# Rows of a batch that goes to a Python worker at most: a batch is held whole on both sides, and texts are long.
BATCH_ROWS = 1000
# Bytes of such a batch under :func:`frugal`.
BATCH_BYTES = 1 << 20


# Python workers live on from task to task. With these settings they give memory back when arrays are freed, instead of
# keeping the most that any task needed; what the environment sets already stays.
ALLOCATION = {
    "ARROW_DEFAULT_MEMORY_POOL": "system",
    "MALLOC_ARENA_MAX": "2",
    "MALLOC_MMAP_THRESHOLD_": str(1 << 20),
    "MALLOC_TRIM_THRESHOLD_": str(16 << 20),
    "OPENBLAS_NUM_THREADS": "1",
}


def reach_workers(spark: SparkSession) -> None:
    """Lets Python workers that start on this file system import the package from where the driver has it, has them
    sent batches of at most ``BATCH_ROWS`` rows, and has them give freed memory back.

    On machines without that folder, ship it with ``--py-files``."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    home = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if home not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([home, *filter(None, paths)])
    for name, value in ALLOCATION.items():
        spark.sparkContext.environment.setdefault(name, value)


def frugal(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """For many steps in one session: scans hold at most ``rows`` rows at a time, and Python workers are sent batches
    of about ``size`` bytes; a row that is longer is a batch by itself. Fewer rows and a size that is set stay."""
    scan, sent = "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(scan, str(min(rows, int(spark.conf.get(scan)))))
    if spark.conf.get(sent, None) is None:
        spark.conf.set(sent, str(size))


def lean(task: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """``task``, a function of batches and more; what it has freed goes back to the system when it ends, since its
    worker lives on beside those of later tasks."""

    @wraps(task)
    def run(batches: Iterable[pa.RecordBatch], *more: object, **named: object) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches, *more, **named)
        finally:
            pa.system_memory_pool().release_unused()

    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


#: Spark's setting that drops the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read from there, so that no lost
    executor makes it computed anew. The files stay until the shared folder is cleaned, or :func:`spent` is called.

    What the write shuffled goes as soon as it is done, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def spent(table: DataFrame) -> None:
    """Deletes the files of a table that :func:`saved` returned; nothing may read it any more."""
    spark = table.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as no column has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bits of the filter that tells most numbers which are not looked for; its size does not grow.
FILTER_BITS = 1 << 26


def bit_filter(numbers: DataFrame, name: str) -> Callable[[DataFrame, str, str], DataFrame]:
    """A function of rows, one of their columns of longs and the name of a new column, which becomes true for all of
    ``numbers``, and for few others while these are few against ``FILTER_BITS``.

    One bit per place is broadcast, in words of 64, so at most ``FILTER_BITS / 64`` rows whatever the size of the table;
    rows are marked by a join with them, without a Python worker beside the one that reads the texts."""
    # FILTER_BITS is a power of two, so numbers below zero have their places as well.
    place = F.pmod(F.col(name), F.lit(FILTER_BITS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(`{name}`, 64) as int))")
    rows = numbers.where(F.col(name).isNotNull()).select(F.shiftright(place, 6).alias("_word"), bit.alias("_bit"))
    words = saved(rows.groupBy("_word").agg(F.bit_or("_bit").alias("_bits")), "filter")

    def marked(df: DataFrame, column: str, flag: str) -> DataFrame:
        at = F.shiftright(F.pmod(F.col(column), F.lit(FILTER_BITS)), 6)
        known = F.expr(f"shiftright(_bits, cast(pmod(`{column}`, 64) as int)) & 1L = 1L")
        joined = df.join(F.broadcast(words), at == F.col("_word"), "left")
        return joined.withColumn(flag, F.coalesce(known, F.lit(False))).drop("_word", "_bits")

    return marked


def wanted(df: DataFrame, column: str, numbers: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` whose ``column`` is among ``numbers``, and few others."""
    flag = unused(df, "_wanted")
    return bit_filter(numbers, name)(df, column, flag).where(flag).drop(flag)


def told(df: DataFrame, column: str, numbers: DataFrame, others: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose ``column`` is among ``numbers``, in two parts; only the second is shuffled.

    ``numbers`` and ``others`` have one column, of the same name; together they hold all that ``column`` may. A row is in
    the second part if a filter can't tell its number from one of ``others``; numbers in both tables are there for sure."""
    (name,) = numbers.columns
    flag, doubt = unused(df, "_wanted"), unused(df, "_doubt")
    marked = bit_filter(numbers, name)
    alike = marked(others, name, flag).where(flag).select(name)
    doubted = bit_filter(alike, name)
    rows = doubted(marked(df, column, flag).where(flag).drop(flag), column, doubt)
    exact = numbers.distinct().withColumnRenamed(name, column)
    return rows.where(~F.col(doubt)).drop(doubt), rows.where(doubt).drop(doubt).join(exact, column, "left_semi")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offset at which each text starts (one more at the end).

    A null counts as an empty text."""
    column = pc.fill_null(column, "") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the texts of each part hold about ``most`` bytes or are a single text."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def record_batch(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
