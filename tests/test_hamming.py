import random

import pytest
from pyspark.sql import functions as F

from kindred.errors import ConfigurationError
from kindred.operators import hamming


def table(spark, rows):
    return spark.createDataFrame(rows, "key bigint, code bigint")


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def sketches(rng, n):
    """Random sketches and others a few bits from them."""
    out = [rng.getrandbits(64) for _ in range(n)]
    for code in list(out):
        for _ in range(rng.randrange(3)):
            near = code
            for bit in rng.sample(range(64), rng.randrange(10)):
                near ^= 1 << bit
            out.append(near)
    return [signed(c) for c in out]


def by_the_book(codes, d):
    codes = sorted(set(codes))
    mask = (1 << 64) - 1
    found = ((a, b, ((a ^ b) & mask).bit_count()) for i, a in enumerate(codes) for b in codes[i + 1 :])
    return sorted(x for x in found if x[2] <= d)


@pytest.mark.parametrize("d", [0, 1, 3, 7, 12])
def test_all_pairs_within_a_distance(spark, d):
    codes = sketches(random.Random(d), 120) + [0, -1, 1, -(1 << 63)]
    rows = [(i, c) for i, c in enumerate(codes)] + [(5000, codes[0]), (5001, None)]
    got = sorted(tuple(r) for r in hamming.close_codes(table(spark, rows), d).collect())
    assert got == by_the_book(codes, d)


@pytest.mark.parametrize("d", [3, 7])
def test_crowded_buckets_are_cut_again(spark, monkeypatch, d):
    """Half of the sketches share their lower 48 bits, so that some buckets stay crowded to the end."""
    monkeypatch.setattr(hamming, "BLOCK", 8)
    rng = random.Random(9)
    codes = sketches(rng, 80) + [signed(rng.getrandbits(16) << 48 | 12345) for _ in range(120)]
    got = sorted(tuple(r) for r in hamming.close_codes(table(spark, list(enumerate(codes))), d).collect())
    assert got == by_the_book(codes, d)


def test_rows_classes_and_numbers_of_links(spark):
    rows = [(7, 0), (3, 0), (9, 1), (4, 3), (5, 1 << 63), (8, None), (None, 3), (3, 0)]
    codes = table(spark, [(k, c if c is None else signed(c)) for k, c in rows]).withColumn("a", F.lit("x")).withColumn("_code", F.lit(1))
    got = sorted(((r.key, r.class_id, r.n_links) for r in hamming.linked(codes, 1).collect()), key=str)
    want = [(7, 3, 2), (3, 3, 2), (3, 3, 2), (9, 9, 2), (4, 4, 1), (None, 4, 1), (5, 5, 1), (8, None, 0)]
    assert got == sorted(want, key=str)


def test_parts_share_no_bit_and_empty_tables(spark):
    for d in range(hamming.MOST_BITS + 1):
        cut = hamming.parts(list(range(64)), d)
        assert sorted(b for p in cut for b in p) == list(range(64)) and len(cut) == d + 1
    empty = table(spark, [])
    assert hamming.close_codes(empty, 3).count() == 0 and hamming.linked(empty, 3).count() == 0
    with pytest.raises(ConfigurationError):
        hamming.close_codes(empty, 16)


def test_no_plan_joins_all_with_all(spark):
    codes = table(spark, list(enumerate(sketches(random.Random(1), 50))))
    plan = hamming.linked(codes, 3)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("codes_of_a_block", [37, 1 << 14])
def test_links_within_many_bits_are_counted_without_pairs(spark, monkeypatch, codes_of_a_block):
    monkeypatch.setattr(hamming, "CODES", codes_of_a_block)
    rng = random.Random(5)
    codes = [*sketches(rng, 150), *(signed(rng.getrandbits(9) << 55) for _ in range(150)), 0, -1]
    rows = list(enumerate(codes)) + [(9000, codes[0]), (9001, None)]
    links = {}
    for a, b, _ in by_the_book(codes, 7):
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
    found = hamming.linked(table(spark, rows), 7)
    first = {c: min(k for k, x in rows if x == c) for c in codes}
    got = {r.key: (r.class_id, r.n_links) for r in found.collect()}
    assert got == {k: (None, 0) if c is None else (first[c], links.get(c, 0)) for k, c in rows}
