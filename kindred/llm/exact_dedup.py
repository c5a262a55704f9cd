"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tables import scratch
from .bitmaps import bitmap, split_by_bitmap
from .common import shared_table, with_group

#: Code points that the prefix hash covers.
PREFIX = 64

#: Bits of the survivor maps.  A map is at most MAP_BITS / 8 bytes (2 MiB) whatever the input, so it can be broadcast.
MAP_BITS = 1 << 24
_BUCKET_BITS = 32_768  # of Spark's bitmap functions


def _survivors(keys: DataFrame) -> DataFrame:
    """(bucket, bits): a bitmap of the hashes ``h`` that occur twice or more; at most 512 rows of 4 KiB."""
    often = keys.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    slot = F.pmod(F.col("h"), F.lit(MAP_BITS))
    return often.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")
    )


def _may_repeat(df: DataFrame, h: Column, bitmap: DataFrame) -> DataFrame:
    """``df`` with the column ``again``: false only if the hash ``h`` of the row occurs once."""
    slot = F.pmod(h, F.lit(MAP_BITS))
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(at, F.lit(8)))), F.lit(2)) == 1
    return (
        df.withColumn("_bucket", F.bitmap_bucket_number(slot))
        .join(F.broadcast(bitmap.withColumnRenamed("bucket", "_bucket")), "_bucket", "left")
        .withColumn("again", F.coalesce(bit, F.lit(False)))
        .drop("_bucket", "bits")
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept``, with ``digest`` also ``text_sha256`` of every row.

    Texts are equal when identical; a null text counts as empty.  The largest id of a group stays.  Lengths that occur
    once are settled first, then (length, prefix) pairs that occur once, and only the others get a full SHA-256.  The
    two survivor sets travel as bitmaps of fixed size; a hash that collides there only costs a full hash.  Groups of any
    size are counted with salted partial aggregates.  A null id never wins over another id; of rows that repeat an id
    and its text, one is kept.  An empty table gives an empty result.
    """
    with scratch() as own:
        out = _groups(docs, id_col, text_col, digest)
        return own.keep(out.withColumnRenamed("sha", "text_sha256") if digest else out.drop("sha"), "groups")


def _groups(docs: DataFrame, id_col: str, text_col: str, digest: bool = False) -> DataFrame:
    """The groups with ``sha``, which texts that are settled early have only where a digest is asked for."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    length_hash = F.xxhash64(F.octet_length("text"))
    prefix_hash = F.xxhash64(F.octet_length("text"), F.substring("text", 1, PREFIX))
    # One scan for both hashes, one for the full hashes of what they leave.
    keys = shared_table(rows.select(length_hash.alias("length"), prefix_hash.alias("prefix")), "hashes")
    lengths = shared_table(_survivors(keys.select(F.col("length").alias("h"))), "lengths")
    prefixes = _may_repeat(keys, F.col("length"), lengths).where("again").select(F.col("prefix").alias("h"))
    prefixes = shared_table(_survivors(prefixes), "prefixes")
    refined = _may_repeat(rows, length_hash, lengths).withColumnRenamed("again", "same_length")
    refined = _may_repeat(refined, prefix_hash, prefixes).withColumn("again", F.col("again") & F.col("same_length"))
    sha = F.sha2("text", 256) if digest else F.when(F.col("again"), F.sha2("text", 256))
    refined = shared_table(refined.select("doc_id", "again", sha.alias("sha")), "hashed")
    single = refined.where(~F.col("again")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    full = refined.where("again").select("doc_id", "sha")
    # Rows that repeat an id and its text count as members; the first of them can stay.
    full = full.groupBy("sha", "doc_id").agg(F.count("*").alias("copies"))
    grouped = with_group(
        full,
        ["sha"],
        F.col("doc_id"),
        {"keep_id": F.max("doc_id"), "group_size": F.sum("copies")},
        {"keep_id": F.max("keep_id"), "group_size": F.sum("group_size")},
    )
    nth = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("nth")
    several = grouped.select("doc_id", "keep_id", "group_size", "sha", nth).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "sha"
    )
    return single.unionAll(several)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` does not keep; all columns stay as they are.

    Rows to drop are looked up by id (null-safely) and text hash; a bitmap of their ids tells which rows need to be moved for
    that.  Where an id repeats with one text, one row stays.
    """
    with scratch() as own:
        lost = _groups(docs, id_col, text_col).where(~F.col("kept")).select(
            F.col("doc_id").alias("_lost"), F.col("sha").alias("_sha"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("_twice")
        )
        lost = own.keep(lost.distinct(), "lost")
    moved, still = split_by_bitmap(docs, F.col(id_col), shared_table(bitmap(lost, F.col("_lost")), "lost-ids"))

    def same(x: DataFrame) -> Column:
        return moved[id_col].eqNullSafe(x["_lost"]) & (F.sha2(F.coalesce(moved[text_col], F.lit("")), 256) == x["_sha"])

    twice = lost.where("_twice")
    again = moved.join(twice, same(twice), "left_semi").dropDuplicates([id_col, text_col])
    return still.unionAll(moved.join(lost, same(lost), "left_anti")).unionAll(again)
