"""What the operators of this subpackage share: readers, written tables, ranks, word hashes."""

from __future__ import annotations

import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import failtriage
from failtriage.session import work_dir

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Spark removes the shuffle files of a finished query at once, not at some later garbage collection.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of one file that are ranked together.
RANK_CHUNK = 50_000


#: Rows that go to a Python worker at a time.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_user: list[tuple[str, Callable[[], None]]] = []


def claim(name: str, clear: Callable[[], None]) -> None:
    """Called in a Python worker by an operator that keeps models or words there: those of the one before go."""
    if _user and _user[0][0] != name:
        _user.pop()[1]()
    if not _user:
        _user.append((name, clear))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the Python workers this package, once for an application; they may start in any folder.

    Batches sent to them are kept small, as texts may be long; a setting of the session's own is left alone.
    """
    context = spark.sparkContext
    if spark.conf.get(BATCH, None) in (None, "10000"):
        spark.conf.set(BATCH, "1000")
    if context.applicationId not in _shipped:
        package = Path(failtriage.__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="failtriage-code-")) / "failtriage_code.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return spark


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once in the shared folder; its own shuffle files go when it is written."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        path = f"{work_dir(spark)}/failtriage-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out), path)
    return out


_paths: dict[int, tuple[weakref.ref, str]] = {}


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that nothing will read any more."""
    for table in tables:
        known, path = _paths.pop(id(table), (lambda: None, ""))
        if known() is table:
            jvm = table.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def text_words(text: Column) -> Column:
    """Words of a text in order; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def ranked(table: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """Number the rows of a *written* table from 0 within each ``key``, without gaps.

    Rows are numbered within pieces of a file, and the pieces of a key get
    running offsets, so a key that holds most rows is still spread over many
    tasks. File and row number identify a row, so a task that runs again gives
    the same numbers.
    """
    rows = table.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    rows = rows.withColumn("_chunk", F.floor(F.col("_row") / RANK_CHUNK))
    part = [key, "_file", "_chunk"]
    before = Window.partitionBy(key).orderBy("_file", "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*part)
        .agg(F.count("*").alias("_n"))
        .select(*part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    local = F.row_number().over(Window.partitionBy(*part).orderBy("_row")) - 1
    return (
        rows.withColumn("_local", local)
        .join(offsets, part)
        .withColumn(rank, F.col("_local") + F.col("_offset"))
        .drop("_file", "_row", "_chunk", "_local", "_offset")
    )


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """UTF-8 bytes of a string column, without decoding; null as no bytes."""
    column = batch.column(batch.schema.get_field_index(name))
    column = column.cast(pa.large_binary()) if pa.types.is_string(column.type) else column.cast(pa.large_binary())
    data = column.buffers()[2]
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    view = memoryview(data) if data is not None else memoryview(b"")
    ends = offsets.tolist()
    valid = column.is_valid().to_pylist() if column.null_count else None
    for i in range(len(column)):
        yield bytes(view[ends[i] : ends[i + 1]]) if valid is None or valid[i] else b""


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` word hashes, by start position."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF))
    for k in range(width):
        out *= np.uint64(0x100000001B3 + 2 * seed)
        out += h[k : k + n]
    return mix(out)
