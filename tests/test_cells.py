"""The exact join at low thresholds: pairs are counted in cells, each once, and are neither written nor exchanged."""

import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.operators import dedupe, skew, tables, truth


def _rows():
    """Copies in a class of 40, near copies, a feature that most have, rows alone, empty and null sets."""
    rng, rows = random.Random(8), [["same", "all", "x"]] * 40
    rows += [[f"n{i}" for i in range(20) if rng.random() < 0.8] + ["all"] for _ in range(60)]
    rows += [[f"r{rng.randrange(80)}" for _ in range(rng.randrange(1, 60))] for _ in range(60)]
    rows += [["alone"], ["two"], ["two"], [], [], None]
    rng.shuffle(rows)
    return list(enumerate(rows))


def _brute(rows, least):
    own = {k: set(f) for k, f in rows if f}
    share = {(a, b): len(x & y) / len(x | y) for (a, x), (b, y) in itertools.combinations(sorted(own.items()), 2)}
    return {p: s for p, s in share.items() if s >= least and s > 0}


@pytest.mark.parametrize("least", [0.01, 0.2])
@pytest.mark.parametrize("cell, block", [(1 << 22, 512), (200, 7)])
def test_all_pairs_each_once(spark, monkeypatch, least, cell, block):
    monkeypatch.setattr(truth, "CELL_FEATURES", cell)
    monkeypatch.setattr(skew, "BLOCK", block)
    rows = _rows()
    found = dedupe.exact_join(spark.createDataFrame(rows, "key long, w array<string>"), "key", F.col("w"), least).collect()
    assert len(found) == len({(r.a, r.b) for r in found}) and {(r.a, r.b): r.jaccard for r in found} == _brute(rows, least)


def test_keys_of_other_types(spark):
    rows = [(f"k{k:03}", f) for k, f in _rows()]
    found = dedupe.exact_join(spark.createDataFrame(rows, "key string, w array<string>"), "key", F.col("w"), 0.1).collect()
    assert {(r.a, r.b): r.jaccard for r in found} == _brute(rows, 0.1)


@pytest.mark.parametrize("pairs, out", [(1 << 22, 1 << 18), (3, 5)])
def test_a_cell_counts_and_hands_on_a_bounded_part_at_a_time(monkeypatch, pairs, out):
    monkeypatch.setattr(truth, "PAIRS", pairs)
    monkeypatch.setattr(truth, "ROWS", out)
    rng = random.Random(2)
    sets = [sorted(rng.sample(range(12), rng.randrange(1, 6))) for _ in range(30)]
    members = [[100 * i + k for k in range(rng.choice((1, 1, 3)))] for i in rng.sample(range(30), 30)]
    table = lambda at: pa.table({"members": [members[i] for i in at], "n": pa.array([len(sets[i]) for i in at], pa.int32()), "f": [sets[i] for i in at]})
    of = {m: set(sets[i]) for i in range(30) for m in members[i]}
    x, y = range(13), range(13, 30)
    got = [r for p in (truth._cell(0.2, table(x), None), truth._cell(0.2, table(y), None), truth._cell(0.2, table(x), table(y))) for t in p for r in t.to_pylist()]
    want = {p: s for p, s in _brute(list(of.items()), 0.2).items()}
    # A row's own members are equal, whatever their features.
    assert len(got) == len(want) and {(r["a"], r["b"]): r["jaccard"] for r in got} == want


def test_pairs_are_neither_written_nor_exchanged(spark):
    """400 sets that share one feature have 79,800 pairs, which were written five times."""
    before = len(tables._open[-1].written)
    df = spark.range(400).select("id", F.array(F.lit("all"), F.col("id").cast("string")).alias("w"))
    found = dedupe.exact_join(df, "id", F.col("w"), 0.01)
    assert max(spark.read.parquet(path).count() for _, path, _ in tables._open[-1].written[before:]) <= 400
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and plan.index("FlatMapGroupsInArrow") < plan.index("Exchange") and found.count() == 79_800
