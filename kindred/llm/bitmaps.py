"""Hash bitmaps of a fixed size: a filter for a join that is small enough to broadcast whatever the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of a bitmap: at most SLOTS / 64 rows of 16 bytes (262,144 rows, 4 MiB).
SLOTS = 1 << 24


def bitmap(keys: DataFrame, key: Column) -> DataFrame:
    """(word, bits): the slots that the hashes of ``key`` fall into."""
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS)).alias("slot")
    return (
        keys.select(slot)
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63L as int))")).alias("bits"))
    )


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _marked(df: DataFrame, key: Column, found: DataFrame, how: str) -> tuple[DataFrame, str]:
    """``df`` with a column that tells whether its key may be in the bitmap, and that column's name."""
    slot, word, bits, may = (unused(df, f"__{x}") for x in ("slot", "word", "bits", "may"))
    slotted = df.withColumn(slot, F.pmod(F.xxhash64(key), F.lit(SLOTS)))
    small = F.broadcast(found.select(F.col("word").alias(word), F.col("bits").alias(bits)))
    is_set = F.coalesce(F.col(bits).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(slot).bitwiseAND(F.lit(63)).cast("int"))) != 0, F.lit(False))
    return slotted.join(small, F.shiftright(slot, 6) == F.col(word), how).withColumn(may, is_set).drop(slot, word, bits), may


def in_bitmap(df: DataFrame, key: Column, found: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be in the bitmap: all that are, and few others while the bitmap is sparse."""
    marked, may = _marked(df, key, found, "inner")
    return marked.where(F.col(may)).drop(may)


def split_by_bitmap(df: DataFrame, key: Column, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in the bitmap, rows whose key is not)."""
    marked, may = _marked(df, key, found, "left")
    return marked.where(F.col(may)).drop(may), marked.where(~F.col(may)).drop(may)
