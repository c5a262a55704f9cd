"""Features are made once for a record, and records of a stream are signed where they lie."""

from pyspark.sql import functions as F

from kindred.functions import features as fx
from kindred.operators import minhash
from kindred.operators.dedupe import Deduplicator, Settings
from kindred.streaming.index import StoredIndex


def test_classes_read_what_was_made_of_features(spark):
    rows = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "e f g h"), (4, None), (5, ""), (6, None)], "key long, text string")
    d = Deduplicator(rows, "key", fx.WordShingles(F.col("text"), 2), Settings(num_perm=16, exact=0.8))
    found = d._classes()
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.key: (r.head, r.second) for r in found.collect()} == {1: (1, 2), 2: (1, 2), 3: (3, None), 4: (4, 6), 6: (4, 6), 5: (5, None)}


def test_a_stream_is_signed_before_it_is_exchanged(spark, tmp_path, monkeypatch):
    plans, sign = [], minhash.sign

    def seen(df, *more):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return sign(df, *more)

    monkeypatch.setattr(minhash, "sign", seen)
    rows = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "d e f"), (3, None)], "key long, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    rows.where("key > 1").unionAll(spark.createDataFrame([(4, "x y z")], rows.schema)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    index = StoredIndex.create(spark, str(tmp_path / "index"), Settings(num_perm=16))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    index.ingest(stream, "key", fx.WordShingles(F.col("text"), 2), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r.key for r in index.live_keys().collect()) == [1, 2, 3, 4]
    assert plans and not any("Aggregate" in p or "Join" in p for p in plans)
