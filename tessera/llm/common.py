"""Helpers shared by the operators: table reads, sizes and the shared folder."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a Python worker, in characters.
SLICE_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of one Arrow batch between Spark and Python; texts are long, so the default of 10,000 rows is much.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """The same rows; batches to and from Python stay small from here on in the session."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate (file sizes for scans); where it knows none, the texts are measured."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 50 else text_bytes(df)


def block_count(df: DataFrame, target_bytes: int, least: int = 1) -> int:
    """Number of groups so that each holds about target_bytes of the input."""
    return max(least, math.ceil(plan_bytes(df) / target_bytes))


def text_bytes(df: DataFrame) -> int:
    """UTF-8 bytes of the texts: file sizes say little of texts that repeat themselves."""
    return int(df.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0)


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI below the cluster's shared checkpoint folder; it is deleted when the session's process ends.

    Where no such folder is set, a local session takes a temporary one; on a cluster that is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif spark.sparkContext.master.startswith("local"):
            root = "file://" + tempfile.mkdtemp(prefix="tessera-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    at = f"{root.rstrip('/')}/tessera-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def materialize(df: DataFrame, at: str) -> DataFrame:
    """Write a table in the shared folder and read it back: cuts the lineage."""
    df.write.mode("overwrite").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts together stay near limit bytes."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def tidy() -> None:
    """Give freed memory of a Python worker back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def same_document(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys where null equals null; the right side's keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        on = c if on is None else on & c
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


#: Rows of one key beyond which a key is hot, at least; hot keys of a join, at most; tasks that share one.
HOT_ROWS, HOT_KEYS, SALTS = 1_000, 20_000, 16


def hot_join(left: DataFrame, right: DataFrame, key: str, *by: str) -> DataFrame:
    """Inner join on key, with right's column `times` telling how many rows of left have its key; `times` is dropped.

    Rows of hot keys are dealt to SALTS tasks by the columns `by`. As many rows as left has can't hold more than HOT_KEYS
    keys that are hot by this rule, so that list is broadcast.
    """
    rows = right.agg(F.sum("times")).first()[0] or 0
    limit = max(HOT_ROWS, rows // HOT_KEYS)
    hot = right.where(F.col("times") > limit).select(F.col(key).alias("__hot"))
    salted = left.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    salted = salted.withColumn("__salt", F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(*by), F.lit(SALTS))).otherwise(0)).drop("__hot")
    salts = F.when(F.col("times") > limit, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    spread = right.withColumn("__s", F.explode(salts)).withColumnRenamed(key, "__key").drop("times")
    return salted.join(spread, (F.col(key) == F.col("__key")) & (F.col("__salt") == F.col("__s"))).drop("__key", "__s", "__salt")
