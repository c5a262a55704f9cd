"""Sinks: pairs, groups, search results and decisions as JSON lines or tab-separated text, published together."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StorageError


def json_text(df: DataFrame) -> DataFrame:
    """One compact JSON object per row, keys sorted."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def pair_text(pairs: DataFrame) -> DataFrame:
    """``left TAB right``, with a similarity to four places where there is one."""
    columns = [F.col("a").cast("string"), F.col("b").cast("string")]
    if "similarity" in pairs.columns:
        columns.append(F.format_string("%.4f", "similarity"))
    return pairs.select(F.concat_ws("\t", *columns).alias("value"))


def group_text(groups: DataFrame) -> DataFrame:
    """``representative TAB members``, members being comma-joined."""
    return groups.select(F.concat_ws("\t", F.col("representative").cast("string"), "members").alias("value"))


def search_rows(found: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """One row per query with its candidates in order, and scores if there are any.

    ``queries`` (``query``, and ``id`` if queries have names of their own) adds those without candidates and the names."""
    scored = "similarity" in found.columns
    if scored:
        pairs = F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "key")))
        out = found.groupBy("query").agg(pairs.alias("p"))
        out = out.select("query", F.col("p.key").alias("candidates"), F.transform("p", lambda p: -p["s"]).alias("scores"))
    else:
        out = found.groupBy("query").agg(F.array_sort(F.collect_set("key")).alias("candidates"))
    if queries is None:
        return out
    names = [c for c in queries.columns if c in ("query", "id")]
    lists = ["candidates", "scores"] if scored else ["candidates"]
    return queries.select(*names).join(out, "query", "left").select(*names, *[F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c) for c in lists])


def search_text(found: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """``query TAB key[:score],...``; with names, ``query TAB id TAB ...``."""
    rows = search_rows(found, queries)
    if "scores" in rows.columns:
        listed = F.array_join(F.zip_with("candidates", "scores", lambda k, s: F.concat(k.cast("string"), F.lit(":"), F.format_string("%.4f", s))), ",")
    else:
        listed = F.array_join(F.col("candidates").cast("array<string>"), ",")
    names = [F.col(c).cast("string") for c in ("query", "id") if c in rows.columns]
    return rows.select(F.concat_ws("\t", *names, listed).alias("value"))


def report_text(report: DataFrame) -> DataFrame:
    """``name: value`` lines of reports (statistics, checks, plans): one for each column of each row, in their order."""
    cells = F.array(*[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("unknown"))) for c in report.columns])
    return report.select(F.explode(cells).alias("value"))


def workload_outputs(base: str, decisions: DataFrame, groups: DataFrame, metrics: dict[str, object]) -> dict[str, DataFrame]:
    """What a deduplication run leaves behind, for ``publish``: groups and decisions as JSON lines and one object of metrics."""
    spark = decisions.sparkSession
    named = spark.range(1).select(*[F.lit(v).alias(k) for k, v in sorted(metrics.items())])
    return {f"{base}/groups.jsonl": json_text(groups), f"{base}/decisions.jsonl": json_text(decisions), f"{base}/metrics.json": json_text(named)}


def publish(spark: SparkSession, outputs: dict[str, DataFrame]) -> None:
    """Write text outputs to their paths, all or none: none may exist; each is staged beside its place and then renamed,
    and if a step fails what was put in place is taken away again."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs = {p: jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf) for p in outputs}
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    for p in outputs:
        if fs[p].exists(path(p)):
            raise StorageError(f"{p} exists")
    staged, placed = {}, []
    try:
        for p, df in outputs.items():
            staged[p] = f"{p}.stage-{uuid.uuid4().hex}"
            df.write.text(staged[p])
        for p, s in staged.items():
            if not fs[p].rename(path(s), path(p)):
                raise StorageError(f"{p} can't be written")
            placed.append(p)
    except Exception:
        for p in placed:
            fs[p].delete(path(p), True)
        for p, s in staged.items():
            fs[p].delete(path(s), True)
        raise
