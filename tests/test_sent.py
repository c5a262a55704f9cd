"""What the driver gathers to send to every task is bounded by rows, for bytes of files don't tell how many rows they hold."""

from pyspark.sql import functions as F

from kindred.operators import lsh
from kindred.operators.dedupe import Deduplicator, Settings


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_signatures_of_many_pairs_are_not_broadcast(spark, monkeypatch):
    """1.2 million equal names lie in a file of a few MB, and their signatures were sent to every task, 546 MB a side, by way of the driver."""
    d = Deduplicator(spark.range(3000).withColumn("w", F.array(F.lit("x"), F.col("id").cast("string"))), "id", F.col("w"), Settings(num_perm=32))
    pairs = spark.range(2999).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    few = d.similarity(pairs)
    monkeypatch.setattr(lsh, "KEYS_SENT", 100)
    monkeypatch.setattr(lsh, "SIGNATURES_SENT", 100)
    many = d.similarity(pairs)
    assert "BroadcastExchange" not in _plan(many) and sorted(many.collect()) == sorted(few.collect()) and many.count() == 2999


def test_next_parts_are_found_without_a_broadcast(spark):
    from kindred.queries import _next

    found = _next(spark.createDataFrame([(1,), (2,), (4,), (5,), (6,)], "p_partkey long"))
    assert "BroadcastExchange" not in _plan(found) and sorted((r.a, r.b) for r in found.collect()) == [(1, 2), (4, 5), (5, 6)]
