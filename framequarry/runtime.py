"""Session helpers shared by all operators: shared storage, sizing, safe column access."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

DEFAULT_SHARED_DIR = "file:///tmp/checkpoints/framequarry"
#: Bytes of one Arrow batch on its way to Python, where the session has no tighter limit of its own.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Where it is unset and all runs in one process on one
    machine (tests), a local default; on a cluster without it, an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = DEFAULT_SHARED_DIR
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
        delete_on_exit(spark, spark.sparkContext.getCheckpointDir())
    return root


def delete_on_exit(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    Cuts the lineage at a table that survives lost executors; every later branch reads the same rows. The files go
    when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def bounded_batches(docs: DataFrame) -> DataFrame:
    """docs, whose rows will travel to Python in batches of at most about BATCH_BYTES, however long their texts are."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name).strip("bB")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return docs


_RESIDENT: dict = {}


def resident(key: tuple, build: Callable[[], object]):
    """What build() gives, kept by this Python process until it is asked for something else: workers serve one stage after
    another, and each may hold a tokenizer or a model of its own."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        give_back()
        _RESIDENT[key] = build()
    return _RESIDENT[key]


def give_back() -> None:
    """Return freed memory to the system; a worker that waits for its next task would keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(run: Callable) -> Callable:
    """A function over Arrow batches that gives freed memory back when its task ends."""

    @functools.wraps(run)
    def over(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return over
