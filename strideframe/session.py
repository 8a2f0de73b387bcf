"""Session helpers: where shared files go and how wide a helper table may be."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session that
    leaves it unset gets a temporary folder, and then for the whole session.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if base:
        return base.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    base = tempfile.mkdtemp(prefix="strideframe-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def arrow_batches(spark: SparkSession, size: str) -> Iterator[None]:
    """Actions inside hand rows to Python in batches of about ``size``; the session's own setting holds again afterwards.

    A batch is held by the JVM and by Python at once, and twice while it grows,
    so wide rows in batches of the usual 64 MB cost some 200 MB per task.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def settle(df: DataFrame, name: str = "step", batch: str | None = None) -> DataFrame:
    """Cut lineage by writing to the shared folder and reading it back.

    Survives the loss of any executor, unlike a local checkpoint. ``batch`` is
    the size of Arrow batches meanwhile (see ``arrow_batches``).
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with arrow_batches(spark, batch) if batch else nullcontext():
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(settled: DataFrame) -> None:
    """Removes the files of a settled table that nothing reads any more."""
    spark = settled.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in settled.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
