"""What the near-copy join does so that executors hold little at a time."""

import pyarrow.parquet as pq

from kindred.llm import common, ngram_join
from kindred.operators import tables

from .conftest import make_docs


def test_a_worker_gives_memory_back_when_another_operator_begins(monkeypatch):
    given = []
    monkeypatch.setattr(common, "trim", lambda: given.append(1))
    monkeypatch.setattr(common, "_owner", ["one"])
    common.own_memos("one")
    assert not given
    common.own_memos("other")
    assert given


def test_tables_between_steps_have_small_row_groups(spark, corpus, monkeypatch):
    written, real = {}, tables.shared_table

    def noted(df, name, options=None):
        out = real(df, name, options)
        written.setdefault(name, []).append((options or {}).get("parquet.block.size"))
        return out

    monkeypatch.setattr(ngram_join, "shared_table", noted)
    monkeypatch.setattr(common, "shared_table", noted)
    ngram_join.jaccard_components(make_docs(spark, corpus)).collect()
    assert {"keys", "short", "buckets", "members", "sets", "links", "edges", "least"} <= set(written)
    assert {size for sizes in written.values() for size in sizes} == {ngram_join.SPLIT_BYTES}


def test_a_row_group_holds_no_more_than_a_split(spark):
    numbers = spark.range(600_000).selectExpr("xxhash64(id) AS a", "xxhash64(id, 1) AS b").coalesce(1)
    (path,) = ngram_join._table(numbers, "groups").inputFiles()
    found = pq.ParquetFile(path.removeprefix("file://")).metadata
    assert found.num_row_groups > 2
    assert max(found.row_group(i).total_byte_size for i in range(found.num_row_groups)) < 2 * ngram_join.SPLIT_BYTES
