"""Members of buckets in files by bucket, so that a search reads the files it asks for and doesn't move the index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one file of a lookup table, and its fewest files.
FILE_ROWS, FEWEST_FILES = 1 << 20, 8

#: Buckets that a search names to the scan, so that files of others aren't opened; beyond it all files are joined where they lie.
FEW_BUCKETS = 512

#: Rows of a search that are sent to every task.
FEW_ASKED = 1 << 16

ROWS = "key BIGINT, band INT, bucket BIGINT"


def file_count(rows: int) -> int:
    """Files for so many rows; a generation keeps the number that it was written with."""
    return max(FEWEST_FILES, -(-rows // FILE_ROWS))


def write(banded: DataFrame, path: str, files: int) -> None:
    """Write ``key, band, bucket`` in so many files by the bucket's hash, sorted by bucket: one exchange, when an index grows."""
    spark, name = banded.sparkSession, f"kindred_{uuid.uuid4().hex}"
    rows = banded.select("key", F.col("band").cast("int").alias("band"), "bucket").repartition(files, "bucket").sortWithinPartitions("bucket", "key")
    try:
        rows.write.format("parquet").bucketBy(files, "bucket").sortBy("bucket").option("path", path).saveAsTable(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # the files stay


def read(spark: SparkSession, path: str, files: int) -> tuple[DataFrame, str]:
    """A lookup table, and the name that the session's catalog has for it until it is dropped."""
    name = f"kindred_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({ROWS}) USING parquet CLUSTERED BY (bucket) SORTED BY (bucket) INTO {files} BUCKETS LOCATION '{path}'")
    return spark.table(name), name


def few_buckets(asked: DataFrame) -> list[int] | None:
    """The buckets asked for if they are no more than ``FEW_BUCKETS``."""
    found = asked.select("bucket").distinct().limit(FEW_BUCKETS + 1).collect()
    return None if len(found) > FEW_BUCKETS else sorted(r.bucket for r in found)


def members(held: DataFrame, asked: DataFrame, few: list[int] | None) -> DataFrame:
    """``asked`` (``band, bucket`` and others) with the ``key`` of each member of those buckets.

    Few buckets are named to the scan and sent to where its files are read; more are exchanged to the files' tasks.  The index
    side is exchanged in neither."""
    asked = asked.withColumnRenamed("band", "_band").withColumnRenamed("bucket", "_bucket")
    if few is not None:
        held = held.where(F.col("bucket").isin(few))
        if asked.limit(FEW_ASKED + 1).count() <= FEW_ASKED:
            asked = F.broadcast(asked)
    return held.join(asked, F.col("bucket") == F.col("_bucket")).where("band = _band").drop("_band", "_bucket")
