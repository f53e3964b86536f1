"""Shared helpers of the training-data operators: the shared folder, written intermediates, size-checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of all contracts: runs of anything but ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Rows of the widest key columns that a checked broadcast may hold.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    A temporary folder is used only where the session names none, as in local tests.
    """
    sc = spark.sparkContext
    set_dir = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    known = sc._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="ledgerloom-"))
        known = sc._jsc.sc().getCheckpointDir()
    return known.get().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage, so that Spark drops the shuffles and broadcasts to which nothing refers any more.

    Long operators call this between their written steps: otherwise spent shuffle files and plans stay until the
    driver's heap happens to fill.
    """
    gc.collect()
    spark._jvm.System.gc()
    release()


def checked_broadcast(small: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if small (already written) has at most max_rows rows; beyond, Spark shuffles it."""
    n = small.limit(max_rows + 1).count()
    return F.broadcast(small) if n <= max_rows else small


def most_frequent(counts: DataFrame, column: str, most: int) -> DataFrame:
    """The rows of a written table with the largest counts: ``most`` at most.

    A histogram of the counts (16 steps a power of two, so a bounded number of rows) gives the least count; no task has
    to hold the largest rows of all others. Rows that tie over the limit are left out together.
    """
    step = F.floor(F.log2(F.col(column).cast("double")) * 16)
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()
    total, least = 0, None
    for r in sorted(steps, key=lambda r: -r["step"]):
        total += r["n"]
        if total > most:
            break
        least = r["step"]
    return counts.where(step >= least) if least is not None else counts.where("false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value, body):
    """Bind a column once and use it many times; lambda variables are evaluated once, aliases may be inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def crc_mod(col, n: int):
    """crc32 of the id as decimal text, modulo n (null: null)."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n))


def blocks(batch: pa.RecordBatch, text: str, max_chars: int = 4_000_000, rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of a batch whose texts hold about max_chars characters (one row at least); null texts become ''.

    Texts are made from the batch a few rows at a time, so no more than a slice and these are held.
    """
    col = batch.column(batch.schema.get_field_index(text))
    at, size, held = 0, 0, []
    for first in range(0, batch.num_rows, rows):
        for x in col.slice(first, rows).to_pylist():
            x = x or ""
            if held and size + len(x) > max_chars:
                yield batch.slice(at, len(held)), held
                at, size, held = at + len(held), 0, []
            size += len(x)
            held.append(x)
    if held:
        yield batch.slice(at), held


def release() -> None:
    """Hand freed memory back at the end of a task, for a Python worker stays alive between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
