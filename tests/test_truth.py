"""The exact join misses no pair, whatever the order of features is, and counts of its pairs are those of the pairs listed."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import dedupe, lsh, truth
from kindred.operators.dedupe import Deduplicator, Settings


def _rows():
    """Families of near copies, exact copies, frequent features, small, empty and null sets."""
    rng, rows = random.Random(4), []
    for family in range(6):
        own = [f"f{family}-{i}" for i in range(rng.choice((3, 10, 40)))]
        for _ in range(9):
            rows.append([x for x in own if rng.random() < 0.85] + [f"c{i}" for i in range(rng.randrange(12))] + [f"x{rng.randrange(30)}" for _ in range(4)])
    rows += [list(rows[3]), list(rows[3])[::-1], rows[7] + rows[7], ["z"], ["z"], ["z", "y"], [], [], None]
    return [(k * 7 % 1009, r) for k, r in enumerate(rows)]


def _pairs(rows, least):
    own = {k: set(f) for k, f in rows if f}
    share = {(a, b): len(own[a] & own[b]) / len(own[a] | own[b]) for a, b in itertools.combinations(sorted(own), 2)}
    return {p: s for p, s in share.items() if s >= least and s > 0}


@pytest.mark.parametrize("least", [0.01, 0.5, 0.7, 0.8, 1.0])
@pytest.mark.parametrize("block, many", [(512, 6), (4, 1)])
def test_all_pairs_that_reach_a_similarity(spark, monkeypatch, least, block, many):
    monkeypatch.setattr(truth, "BLOCK", block)
    monkeypatch.setattr(truth, "MANY", many)
    rows = _rows()
    found = dedupe.exact_join(spark.createDataFrame(rows, "key long, w array<string>"), "key", F.col("w"), least).collect()
    assert len(found) == len({(r.a, r.b) for r in found}) and {(r.a, r.b): r.jaccard for r in found} == pytest.approx(_pairs(rows, least))


def test_copies_and_features_are_not_joined_in_pairs(spark):
    """Of 300 copies and a feature that all have, the old join made a row for each pair and feature."""
    df = spark.range(300).select("id", F.array(F.lit("all"), F.when(F.col("id") < 200, F.lit("same")).otherwise(F.col("id").cast("string"))).alias("w"))
    found, links = dedupe.exact_classes(df, "id", F.col("w"), 0.9)
    assert links.count() == 0 and found.where("head = key").count() == 101 and found.where("head = 0").count() == 200


def test_quality_is_counted_as_pairs_would_be(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "key long, w array<string>")
    d = Deduplicator(df, "key", F.col("w"), Settings(threshold=0.6, num_perm=32))
    assert d.exact_quality(0.5).collect() == lsh.quality(d.candidate_pairs(), dedupe.exact_join(df, "key", F.col("w"), 0.5)).collect()
    even = F.expr("key % 2 = 0")
    pairs = dedupe.exact_join(df, "key", F.col("w"), 0.4).where("a % 2 <> b % 2")
    pairs = pairs.select(F.when(F.expr("a % 2 = 0"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.expr("a % 2 = 0"), F.col("b")).otherwise(F.col("a")).alias("b"))
    want = lsh.cross_source_quality(d.signed, "key", df.select("key", even.alias("left")), pairs, [0.4, 0.8], 32).orderBy("threshold")
    got = d.cross_quality(even, 0.4, [0.4, 0.8])
    assert got.dtypes == want.dtypes and got.collect() == want.collect()


def test_prefixes_need_no_frequent_features(spark):
    own = truth.sets(spark.createDataFrame(_rows(), "key long, w array<string>"), "key", F.col("w"))
    got = {r.key: r.n for r in truth.prefixes(own, 0.5, np.array([], np.int64)).collect()}
    assert got == {k: len(set(f)) for k, f in _rows() if f}
