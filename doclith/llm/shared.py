"""Tables that cut lineage, in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir. Where that is unset, a temporary one if all runs on this machine (tests),
    and else an error: executors elsewhere would not see it."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="doclith-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Of a table's row groups: a task holds one of them in memory until it is full, and the task that reads it a column of one.
GROUP_BYTES = 16 << 20

#: While a table is written: an execution's shuffle files go when it ends, and Arrow batches are bounded by bytes.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
_lock = threading.Lock()
_at_work: dict[int, tuple[int, dict]] = {}  # by session: writes at work, and what the settings were before the first


@contextlib.contextmanager
def _writing(spark: SparkSession):
    """The settings, until the last of the writes at work ends."""
    with _lock:
        n, before = _at_work.get(id(spark), (0, None))
        _at_work[id(spark)] = (n + 1, before or {k: spark.conf.get(k, None) for k in WRITING})
        for k, v in WRITING.items():
            spark.conf.set(k, v)
    try:
        yield
    finally:
        with _lock:
            n, before = _at_work.pop(id(spark))
            if n > 1:
                _at_work[id(spark)] = (n - 1, before)
            else:
                for k, v in before.items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _store(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _write(df: DataFrame, path: str) -> DataFrame:
    """What the table is made of isn't needed once it is written, so its shuffle files go at once."""
    spark = df.sparkSession
    with _writing(spark):
        df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as Parquet in the shared folder and read back: later jobs and retries reread the files. The
    table is removed when the application ends."""
    path = new_path(df.sparkSession, name)
    at, store = _store(df.sparkSession, path)
    store.deleteOnExit(at)
    return _write(df, path)


class Drafts:
    """Tables like those of :func:`keep` that are removed together, when what was made of them is written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(new_path(self.spark, name))
        at, store = _store(self.spark, self.paths[-1])
        store.deleteOnExit(at)
        return _write(df, self.paths[-1])

    def remove(self) -> None:
        for path in self.paths:
            at, store = _store(self.spark, path)
            store.delete(at, True)
        self.paths = []


def cut(df: DataFrame) -> DataFrame:
    """For small state of loops: a reliable checkpoint, removed when nothing refers to it any more."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def sampled(df: DataFrame, hashed: Column, rows: int) -> DataFrame:
    """About ``rows`` of the rows, all if there are no more: those whose 64-bit hash is below the bound that their number
    gives. Unlike an order with a limit it moves nothing, and no partition sends more than its share."""
    share = rows / max(df.count(), 1)
    return df if share >= 1 else df.where(F.pmod(hashed, F.lit(1 << 32)) < int(share * (1 << 32)))
