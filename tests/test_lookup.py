import random
from pathlib import Path
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from kindred.errors import DuplicateKeyError
from kindred.operators import graph, lsh
from kindred.operators.dedupe import Settings
from kindred.streaming import groups, lookup
from kindred.streaming.groups import GroupedIndex
from kindred.streaming.index import StoredIndex

LAW = (4, 1, 32)


def rows(spark, records):
    return spark.createDataFrame([(k, list(s)) for k, s in records.items()], "key long, signature array<long>")


def settings():
    return Settings(num_perm=4, threshold=0.5)


def linked(records, bands):
    """Components of records that agree in a band, by the book."""
    n, width = bands
    root = {k: k for k in records}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(records)
    for x in keys:
        for y in keys:
            if x < y and any(records[x][i * width : (i + 1) * width] == records[y][i * width : (i + 1) * width] for i in range(n)):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {k: find(k) for k in records}


def test_searches_by_lookup_equal_those_by_exchange(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    make = lambda ids: {i: tuple(rng.randrange(6) for _ in range(4)) for i in ids}
    first, second, again = make(range(60)), make(range(60, 110)), make(range(0, 60, 5))
    found = {}
    for lookups in (False, True):
        index = StoredIndex.create(spark, f"{tmp_path}/{lookups}", settings(), lookups=lookups)
        index.insert_signatures(rows(spark, first), LAW).insert_signatures(rows(spark, second), LAW)
        index.remove(rows(spark, again), "key")
        index.insert_signatures(rows(spark, again), LAW)
        asked = rows(spark, {1000 + k: v for k, v in (first | second).items()})
        found[lookups] = sorted(map(tuple, index.search_signatures(asked, "key").collect()))
        if lookups:
            monkeypatch.setattr(lookup, "FEW_BUCKETS", 3)
            assert sorted(map(tuple, index.search_signatures(asked, "key").collect())) == found[True]
            index.compact()
            assert sorted(map(tuple, index.search_signatures(asked, "key").collect())) == found[True]
            opened = StoredIndex.open(spark, f"{tmp_path}/{lookups}", read_only=True)
            assert sorted(map(tuple, opened.search_signatures(asked, "key").collect())) == found[True]
            opened.close()
            assert index.vacuum() > 0 and sorted(map(tuple, index.search_signatures(asked, "key").collect())) == found[True]
            with pytest.raises(DuplicateKeyError):
                index.insert_signatures(rows(spark, {1: (1, 2, 3, 4)}), LAW)
            assert sorted(map(tuple, index.search_signatures(asked, "key").collect())) == found[True]
    assert found[False] == found[True] and len(found[True]) > 100


def test_a_search_moves_no_index_rows_and_opens_few_files(spark, tmp_path):
    held = spark.range(40_000).select(F.col("id").alias("key"), F.lit(0).alias("band"), F.xxhash64("id").alias("bucket"))
    lookup.write(held, f"{tmp_path}/look", 64)
    table, name = lookup.read(spark, f"{tmp_path}/look", 64)
    asked = held.where("key in (7, 70, 700)").select(F.col("key").alias("query"), "band", "bucket")
    few = lookup.few_buckets(asked)
    assert "Exchange hashpartitioning" not in lookup.members(table, asked, few)._jdf.queryExecution().executedPlan().toString()
    # Very many: the queries go to the files' tasks, the index stays.
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        every = lookup.members(table, held.select(F.col("key").alias("query"), "band", "bucket"), None)
        text = every._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(_bucket" in text
        assert every.where("query = key").count() == 40_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # What holds none of the buckets asked for is not opened.
    needed = {Path(unquote(r.f)).name for r in table.where("key in (7, 70, 700)").select(F.input_file_name().alias("f")).collect()}
    others = [f for f in (tmp_path / "look").glob("part-*") if f.name not in needed]
    for f in others:
        f.write_bytes(b"no Parquet")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    assert len(others) >= 61
    assert sorted(r.key for r in lookup.members(table, asked, few).collect()) == [7, 70, 700]
    spark.sql(f"DROP TABLE {name}")


@pytest.mark.parametrize("seed", [1, 2])
def test_labels_stay_those_of_a_batch_over_random_changes(spark, tmp_path, seed, monkeypatch):
    monkeypatch.setattr(groups, "MOST_LABELS", 4)
    rng = random.Random(seed)
    index = GroupedIndex.create(spark, f"{tmp_path}/index", settings())
    held, bands = {}, (index.meta["bands"], index.meta["rows"])
    for _ in range(7):
        if held and rng.random() < 0.45:
            gone = rng.sample(sorted(held), min(len(held), rng.randint(1, 12)))
            assert index.remove(spark.createDataFrame([(k,) for k in gone], "key long"), "key") == len(gone)
            for k in gone:
                del held[k]
        else:
            ids = rng.sample([i for i in range(90) if i not in held], rng.randint(1, 25))
            new = {i: tuple(rng.randrange(7) for _ in range(4)) for i in ids}
            index.insert_signatures(rows(spark, new), LAW)
            held |= new
        assert {r.node: r.component for r in index.components().collect()} == linked(held, bands)
    opened = GroupedIndex.open(spark, f"{tmp_path}/index", read_only=True)
    found = graph.components(lsh.anchor_pairs(opened.bands()))
    every = {r.node: r.component for r in graph.with_singletons(found, opened.live(), "key").collect()}
    assert {r.key: r.representative for r in opened.decisions().collect()} == every


def test_a_batch_writes_labels_of_what_it_touches(spark, tmp_path):
    index = GroupedIndex.create(spark, f"{tmp_path}/index", settings())
    index.insert_signatures(rows(spark, {i: (i, i, i, i) for i in range(100, 300)}), LAW)
    index.insert_signatures(rows(spark, {5: (150, 150, 150, 150), 6: (7, 7, 7, 7)}), LAW)
    last = {r.key: r.component for r in index._labels(index.meta["labels"][-1]).collect()}
    assert last == {5: 5, 150: 5, 6: 6}
    index.remove(spark.createDataFrame([(5,)], "key long"), "key")
    assert {r.key: r.component for r in index._labels(index.meta["labels"][-1]).collect()} == {5: None, 150: 150}
