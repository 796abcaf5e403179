"""Reading tables and cutting lineage through the folder that the cluster shares."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that a Python worker is sent at once where whole texts go to it. An executor holds some copies of a batch for each
#: core, in the JVM outside its heap and in the worker; by Spark's own bounds (10,000 rows, 64 MB) they are tens of MB each.
SMALL = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset (tests, one machine), a new
    temporary folder is set once for the session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-assay-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings are ``values`` while a job runs, then what they were."""
    was = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession):
    """While it holds, jobs send rows to Python workers ``SMALL`` bytes at a time (a longer row alone)."""
    return settings(spark, {_BATCH: str(SMALL)})


def stage(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder as Parquet and reads it back: lineage ends here, and a
    lost executor costs a reread, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/assay-{uuid.uuid4().hex}"
    with settings(spark, {_CLEANUP: "true"}):  # once written, the shuffle files behind it are of no use
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_in_small_batches(df: DataFrame) -> DataFrame:
    """``stage``, for what Python workers make of whole texts."""
    with small_batches(df.sparkSession):
        return stage(df)


def stage_measured(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """``stage``, and aggregates of the rows, taken while they are written."""
    seen = Observation()
    return stage(df.observe(seen, *[c.alias(k) for k, c in measures.items()])), seen.get


def drop_staged(df: DataFrame) -> None:
    """Deletes the files of a table that ``stage`` wrote and that no later step reads."""
    spark = df.sparkSession
    root = shared_dir(spark)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/assay-" in folder and root.removeprefix("file://").rstrip("/") in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def crc_remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % modulus


def tasks_for(df: DataFrame, at_least: int = 1) -> int:
    """Shuffle width of the session, for an explicit repartition."""
    return max(at_least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


_kept: dict[str, Any] = {}


def kept(name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gave when this Python worker first asked for it; ``lean`` tasks that don't name it let it go."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def lean(task: Callable[..., Iterator[pa.RecordBatch]], keeps: str = "") -> Callable[..., Iterator[pa.RecordBatch]]:
    """``task``, before which its Python worker lets go what tasks of others ``kept`` and after which it gives
    freed memory back to the system. Workers live on between tasks, and what they hold counts against the executor."""

    @wraps(task)
    def run(*args):
        for name in _kept.keys() - {keeps}:
            del _kept[name]
        try:
            yield from task(*args)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
            if trim:
                trim(0)

    return run


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished rounds, which it does only for plans
    that neither Python nor the JVM refers to any more."""
    gc.collect()
    spark._jvm.System.gc()
