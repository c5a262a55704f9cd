"""URL filters by a temporal list join: dated entries become validity intervals; captures meet those active when fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table

#: Intervals up to which they are broadcast; more of them are joined by key, and skewed keys are split by the join.
BROADCAST_ROWS = 100_000

#: Scheme, user, host; the port and what follows is left out.
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host_of(url: Column) -> Column:
    """Lower-case host without a dot at its end; null where there is none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.lower(url), HOST, 1), "[.]+$", ""), F.lit(""))


def validity(entries: DataFrame) -> DataFrame:
    """Intervals ``key, list, verdict, since, until`` [since, until) from dated entries ``list, key, action, verdict, at``.

    An entry of ``add`` holds until the next entry of its list and key, which may be an ``add`` with another verdict; a
    ``remove`` ends it.  Of several entries of one time, ``remove`` counts last, then ``block`` before ``allow``.  Rows with a
    null list, key, action or time are left out; an ``add`` without a verdict blocks.
    """
    rows = entries.where("list is not null and key is not null and action in ('add', 'remove') and at is not null").select(
        "list", F.lower("key").alias("key"), "at",
        F.when(F.col("action") == "remove", 2).when(F.col("verdict") == "allow", 1).otherwise(0).alias("state"),
    )
    at_once = rows.groupBy("list", "key", "at").agg(F.max("state").alias("state"))
    later = F.lead("at").over(Window.partitionBy("list", "key").orderBy("at"))
    return at_once.withColumn("until", later).where("state <> 2").select(
        "key", "list", F.when(F.col("state") == 1, "allow").otherwise("block").alias("verdict"), F.col("at").alias("since"), "until"
    )


def filter_urls(
    captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, time: Column, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """One row per capture: ``id, host, fetched, blocked, verdict, matched, lists``.

    An entry's key is a domain; it covers the host itself and all below it.  Of the entries active at the time of the fetch
    the one with the longest domain decides, ``allow`` before ``block`` among equals; ``matched`` is that domain and ``lists``
    are the lists that say so, sorted and comma-joined.  A null or malformed URL or a null time meets no entry and is not
    blocked; rows that repeat an id, or have none, are judged one by one.  Without entries nothing is blocked; without
    captures the result is empty.  Only the three columns of a capture are read, so no name can clash.
    """
    rows = captures.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), time.alias("fetched"))
    rows = shared_table(rows.withColumn("row", F.monotonically_increasing_id()), "captures")
    intervals = shared_table(validity(entries), "intervals")
    if intervals.count() <= broadcast_rows:
        intervals = F.broadcast(intervals)
    labels = F.split("host", "[.]")
    keys = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = rows.where("host is not null and fetched is not null").select("row", "fetched", F.explode(keys).alias("asked"))
    active = (F.col("asked") == F.col("key")) & (F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    met = asked.join(intervals, active).groupBy("row", "key", "verdict").agg(F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"))
    rank = F.struct(F.length("key").alias("n"), (F.col("verdict") == "allow").alias("allow"), F.col("key"), F.col("verdict"), F.col("lists"))
    best = met.groupBy("row").agg(F.max(rank).alias("b"))
    return rows.join(best, "row", "left").select(
        "id", "host", "fetched", F.coalesce(F.col("b.verdict") == "block", F.lit(False)).alias("blocked"),
        F.col("b.verdict").alias("verdict"), F.col("b.key").alias("matched"), F.col("b.lists").alias("lists"),
    )
