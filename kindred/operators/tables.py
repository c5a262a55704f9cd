"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where that is unset and all tasks run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kindred-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class Scratch:
    """Tables that are deleted when the work that needs them is done."""

    def __init__(self) -> None:
        self.written: list[tuple[SparkSession, str, str | None]] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write what the work returns as a table that outlives it."""
        _open.remove(self)
        try:
            return shared_table(df, name)
        finally:
            _open.append(self)

    def drop(self) -> None:
        for spark, path, table in self.written:
            try:
                if table:
                    spark.sql(f"DROP TABLE IF EXISTS {table}")
                jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
                jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
            except Exception:  # noqa: BLE001  the JVM may be gone by now
                return
        self.written.clear()


#: The innermost is where new tables belong; those of the first live until the process ends.
_open: list[Scratch] = [Scratch()]


@contextlib.contextmanager
def scratch() -> Iterator[Scratch]:
    """Tables that are written inside are deleted at the end, but for those that ``keep`` returns."""
    own = Scratch()
    _open.append(own)
    try:
        yield own
    finally:
        _open.remove(own)
        own.drop()


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/kindred-{name}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and no executor owns it.
    ``options`` are those of the writer."""
    spark = df.sparkSession
    path = _place(spark, name)
    _open[-1].written.append((spark, path, None))
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed_table(df: DataFrame, name: str, buckets: int, column: str, options: dict | None = None) -> DataFrame:
    """As ``shared_table``, in buckets by ``column``: joins on it with as many partitions don't move this side."""
    spark = df.sparkSession
    path = _place(spark, name)
    table = f"kindred_{uuid.uuid4().hex}"
    _open[-1].written.append((spark, path, table))
    df.write.bucketBy(buckets, column).options(path=path, **(options or {})).format("parquet").saveAsTable(table)
    return spark.table(table)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _drop_shared_tables() -> None:
    for own in _open:
        own.drop()
