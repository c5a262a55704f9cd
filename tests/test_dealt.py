"""A table in few files is dealt out by its size, not by the number of cores alone."""

from kindred import queries


def test_parts_grow_with_the_table(spark, tmp_path, monkeypatch):
    spark.range(4000).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    cores = spark.sparkContext.defaultParallelism
    assert queries.table(spark, str(tmp_path), "t").rdd.getNumPartitions() == cores
    monkeypatch.setattr(queries, "PART_BYTES", 1000)
    found = queries.table(spark, str(tmp_path), "t")
    assert found.rdd.getNumPartitions() > 2 * cores and found.count() == 4000


def test_a_table_in_files_of_moderate_size_is_not_exchanged(spark, tmp_path, monkeypatch):
    path = tmp_path / "documents.parquet"
    spark.range(4000).selectExpr("id as doc_id", "uuid() as text").repartition(8).write.parquet(str(path))
    size = sum(f.stat().st_size for f in path.glob("*.parquet"))
    exchanged = lambda: "Repartition" in queries.table(spark, str(tmp_path), "documents")._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(queries, "PART_BYTES", size // 16)
    assert not exchanged()
    monkeypatch.setattr(queries, "PART_BYTES", size // 64)
    assert exchanged()
