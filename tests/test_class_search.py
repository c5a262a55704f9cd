"""Searches of a stored index by classes of equal signatures: the rows of each query against each key."""

from pyspark.sql import functions as F

from kindred.functions import features as fx
from kindred.operators.dedupe import Settings
from kindred.streaming.index import StoredIndex

NAMES = ["large red ring", "large red rings", "large red rung", "hot bolt", "hot bolts", ""]


def test_search_lists_and_ranks_copies_as_single_records(spark, tmp_path):
    """Six names shared by 1,300 records, so that classes lie in several lists, and every tenth record asks."""
    rows = spark.createDataFrame([(k, NAMES[k % 6] if k % 13 else None) for k in range(1300)], "key long, name string")
    index = StoredIndex.create(spark, str(tmp_path / "i"), Settings(threshold=0.5, num_perm=32))
    own = fx.char_shingles(F.col("name"), 3)
    index.insert(rows, "key", own)
    asking = rows.where("key % 10 = 0")
    live = {r.key: r for r in index.live().collect()}
    asked = sorted(r.key for r in asking.collect())
    meet = {(q, k) for q in asked for k in live if any(x == y for x, y in zip(live[q].buckets, live[k].buckets, strict=True))}
    share = lambda q, k: sum(x == y for x, y in zip(live[q].signature, live[k].signature, strict=True)) / 32
    found = [(r["query"], r["key"]) for r in index.search(asking, "key", own).collect()]
    assert len(found) == len(set(found)) and set(found) == meet
    scored = {(r["query"], r["key"], r["similarity"]) for r in index.search(asking, "key", own, min_similarity=0.6).collect()}
    assert scored == {(q, k, share(q, k)) for q, k in meet if share(q, k) >= 0.6}
    for k in (1, 3, 400):
        want = set()
        for q in asked:
            best = sorted((-share(q, x), x) for p, x in meet if p == q)[:k]
            want |= {(q, x, -s, i + 1) for i, (s, x) in enumerate(best)}
        assert {(r["query"], r["key"], r["similarity"], r["rank"]) for r in index.search(asking, "key", own, top_k=k).collect()} == want


def test_top_search_exchanges_no_row_for_each_pair(spark, tmp_path):
    """1,000 copies: no step of a search for the best may make a row for each query and each copy."""
    rows = spark.range(1000).select(F.col("id").alias("key"), F.lit("one and the same").alias("name"))
    index = StoredIndex.create(spark, str(tmp_path / "i"), Settings(num_perm=32))
    own = fx.char_shingles(F.col("name"), 3)
    index.insert(rows, "key", own)
    found = index.search(rows, "key", own, top_k=3)
    assert found.count() == 3000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket" not in plan.split("Window")[0] and {r["key"] for r in found.select("key").distinct().collect()} == {0, 1, 2}
