"""Predicates, representatives, results, and the parts that skewed groups need."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from kindred.errors import CompatibilityError, ConfigurationError, InvalidRepresentativeError
from kindred.functions import hashing
from kindred.operators import graph, lsh, minhash, skew
from kindred.operators.dedupe import Deduplicator, Settings, deduplicate, row_predicate
from kindred.streaming.index import StoredIndex

from .test_engine import union_find


def same(df, **more):
    return deduplicate(df, "key", F.array(F.lit("same")), num_perm=32, **more)


def test_a_result_has_groups_and_partitions_in_order(spark):
    rows = spark.createDataFrame([(0, "alpha beta gamma delta", 1), (1, "alpha beta gamma delta", 9), (2, "red green blue orange", 5)], "key long, text string, score int")
    r = deduplicate(rows, "key", F.split("text", " "), num_perm=64, seed=7)
    assert (r.group_count, r.duplicate_count) == (1, 1)
    assert [(x.representative, x.key, x.size) for x in r.groups.orderBy("key").collect()] == [(0, 0, 2), (0, 1, 2)]
    assert [x.key for x in r.kept.orderBy("key").collect()] == [0, 2] and [x.key for x in r.dropped.collect()] == [1]
    assert r.kept.columns == rows.columns and r.dropped.columns == rows.columns


FAMILIES = [lambda a, b: a["family"] == b["family"], row_predicate(lambda a, b: a["family"] == b["family"])]


@pytest.mark.parametrize("predicate", FAMILIES)
def test_a_predicate_filters_collisions(spark, predicate):
    rows = spark.createDataFrame([(0, 1), (1, 1), (2, 2)], "key long, family int")
    r = same(rows, predicate=predicate)
    assert [(x.key, x.keep, x.representative) for x in r.decisions.orderBy("key").collect()] == [(0, True, 0), (1, False, 0), (2, True, 2)]


def test_predicates_link_as_if_all_pairs_were_asked(spark):
    """Also where members of a class don't link among themselves but with another class."""
    rng = random.Random(4)
    rows = [(i, rng.randrange(4), rng.randrange(3)) for i in range(60)]
    df = spark.createDataFrame(rows, "key long, x int, y int")
    asked = [
        (lambda a, b: a["x"] != b["x"], lambda a, b: a[1] != b[1]),
        (lambda a, b: (a["x"] + b["x"] == 3) & (a["y"] == b["y"]), lambda a, b: a[1] + b[1] == 3 and a[2] == b[2]),
        (lambda a, b: a["x"] * a["y"] == b["x"], lambda a, b: a[1] * a[2] == b[1]),
    ]
    for column, plain in asked:
        want = union_find([(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if plain(a, b)], [r[0] for r in rows])
        assert {r.key: r.representative for r in same(df, predicate=column).decisions.collect()} == want


def test_representatives_by_preference_and_by_function(spark):
    rows = spark.createDataFrame([(0, 1), (1, 10)], "key long, score int")
    for choose in (F.col("score"), lambda group: group.loc[group["score"].idxmax(), "key"]):
        r = same(rows, representative=choose)
        assert [x.key for x in r.kept.collect()] == [1] and [x.key for x in r.dropped.collect()] == [0]
        assert {x.representative for x in r.groups.collect()} == {1}


def test_a_representative_from_outside_is_an_error(spark):
    rows = spark.createDataFrame([(1,), (2,)], "key long")
    with pytest.raises(InvalidRepresentativeError):
        same(rows, representative=lambda group: 99)


def test_similarity_of_any_pair(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, ["z"])], "key long, f array<string>")
    d = Deduplicator(rows, "key", F.col("f"), Settings(num_perm=64))
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    got = {(r.a, r.b): r.similarity for r in d.similarity(pairs).collect()}
    assert got[1, 2] == 1.0 and got[1, 3] < 0.2
    with pytest.raises(ConfigurationError):
        d.similarity(spark.createDataFrame([(1, 9)], "a long, b long"))


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_components_by_rounds_and_in_one_task(spark, few):
    rng = random.Random(19)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(90)] + [(7000, 7000 + i) for i in range(300)]
    edges += [(5000, 5000), (2, 1), (2, 1)]
    df = spark.createDataFrame([*edges, (None, 4), (4, None)], "a long, b long")
    assert {r.node: r.component for r in graph.components(df, few=few).collect()} == union_find(edges, {n for e in edges for n in e})
    names = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "a string, b string")
    assert {r.node: r.component for r in graph.components(names, few=few).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert graph.components(df.where("false"), few=few).count() == 0


def test_large_buckets_are_paired_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(skew, "BLOCK", 7)
    rows = [(i, 0, 5) for i in range(60)] + [(i, 1, i % 9) for i in range(60)]
    banded = spark.createDataFrame(rows, "key long, band int, bucket long")
    assert {(r.a, r.b) for r in lsh.candidate_pairs(banded).collect()} == set(itertools.combinations(range(60), 2))
    found = spark.createDataFrame([(i, i % 4) for i in range(50)], "node long, component long")
    label = lambda i: i % 4 if i < 50 else i
    want = {(a, b) for a, b in itertools.combinations(range(60), 2) if label(a) != label(b)}
    assert {(r.a, r.b) for r in lsh.pairs_across(banded, found).collect()} == want


def test_members_of_groups_of_any_size(spark):
    found = spark.createDataFrame([(i, 0) for i in range(200)] + [(300, 300)], "node long, component long")
    assert {(r.component, r.size) for r in graph.members(found).collect()} == {(0, 200)} and graph.members(found).count() == 200
    assert graph.members(found, 1).count() == 201


def test_wide_signatures_merge_without_a_sign(spark):
    rng = random.Random(2)
    rows = [(i, i % 3, [f"f{rng.randrange(50)}" for _ in range(rng.randint(0, 9))]) for i in range(30)]
    df = spark.createDataFrame(rows, "key long, g int, f array<string>")
    signed = minhash.sign(df, "key", F.col("f"), 64, 5, 64).join(df, "key")
    whole = df.groupBy("g").agg(F.flatten(F.collect_list("f")).alias("f"))
    want = {r.g: r.signature for r in minhash.sign(whole, "g", F.col("f"), 64, 5, 64).collect()}
    assert {r.g: r.signature for r in minhash.merge(signed, ["g"], 64, 64).collect()} == want
    assert {r.key for r in signed.where(minhash.is_empty(F.col("signature"), 64)).collect()} == {i for i, _, f in rows if not f}


def test_published_band_hashes(spark):
    rng = random.Random(8)
    rows = [(i, [rng.getrandbits(32) for _ in range(12)]) for i in range(20)]
    signed = spark.createDataFrame(rows, "key long, signature array<bigint>")
    got = {(r.key, r.band): r.bucket & hashing.M64 for r in lsh.band_rows(signed, "key", 4, 3, published=True).collect()}
    assert got == {(k, b): hashing.band_hash(s[3 * b : 3 * b + 3]) for k, s in rows for b in range(4)}


def test_percentiles_of_many_tasks(spark):
    rng = random.Random(3)
    values = [round(rng.random() * 50, 1) for _ in range(700)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(5)
    r = lsh.latency_percentiles(df, "v").first()
    at = lambda p: sorted(values)[-(-p * (len(values) - 1) // 100)]
    assert (r.p50, r.p95, r.p99) == (at(50), at(95), at(99))
    assert tuple(lsh.latency_percentiles(df.where("false"), "v").first()) == (None, None, None)


def names(spark, n=30):
    return spark.createDataFrame([(i, f"name number {i}") for i in range(n)], "key long, name string")


def chars():
    return F.filter(F.split("name", ""), lambda c: c != "")


def test_an_index_of_buckets_alone(spark, tmp_path):
    index = StoredIndex.create(spark, str(tmp_path / "a"), Settings(num_perm=32, store_signatures=False))
    index.insert(names(spark), "key", chars())
    assert not index.stores_signatures and index.signature(3) is None and len(index) == 30
    whole = StoredIndex.create(spark, str(tmp_path / "b"), Settings(num_perm=32))
    whole.insert(names(spark), "key", chars())
    ask = names(spark, 5)
    found = lambda i: {(r.query, r.key) for r in i.search(ask, "key", chars()).collect()}
    assert found(index) == found(whole) and len(whole.signature(3)) == 32 and whole.signature(99) is None
    for more in ({"min_similarity": 0.1}, {"top_k": 2}):
        with pytest.raises(ConfigurationError, match="does not store signatures"):
            index.search(ask, "key", chars(), **more)
    assert {r.n for r in index.verify().collect()} == {0}
    assert {r.n for r in StoredIndex.open(spark, str(tmp_path / "a")).verify().collect()} == {0}


def test_reports_on_an_index(spark, tmp_path):
    index = StoredIndex.create(spark, str(tmp_path / "i"), Settings(num_perm=32, threshold=0.7)).insert(names(spark), "key", chars())
    s = index.stats().first()
    assert (s.memberships, s.version, s["generations"], s["keys"]) == (30 * index.meta["bands"], 1, 1, 30) and s.bytes > 0
    e = index.explain(budget=1 << 30).first()
    assert (e.parameter_source, e.expected_items, e.bands) == ("existing", 30, index.meta["bands"])


def test_refused_batches_leave_nothing_behind(spark, tmp_path):
    from kindred.errors import DuplicateKeyError

    index = StoredIndex.create(spark, str(tmp_path / "i"), Settings(num_perm=16)).insert(names(spark), "key", chars())
    for bad in (names(spark, 31), names(spark).union(names(spark)).where("key = 3")):
        with pytest.raises(DuplicateKeyError):
            index.insert(bad, "key", chars())
    wrong = minhash.sign(names(spark, 40).where("key > 35"), "key", chars(), 8, 1)
    with pytest.raises(CompatibilityError):
        index.insert_signatures(wrong, (16, 1, 32))
    assert len(index) == 30 and len([p for p in (tmp_path / "i").iterdir() if p.name.startswith("gen-")]) == 1


def test_a_lost_generation_is_found(spark, tmp_path):
    import shutil

    index = StoredIndex.create(spark, str(tmp_path / "i"), Settings(num_perm=16)).insert(names(spark), "key", chars())
    shutil.rmtree(tmp_path / "i" / index.meta["generations"][0])
    assert [(r.problem, r.n) for r in index.verify().collect()] == [("missing_generations", 1)]
