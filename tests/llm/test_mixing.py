import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kindred.llm import mixing

from .conftest import SCHEMA


def targets_by_the_book(sizes, weights=(5, 2, 1), share=1.0, most=3):
    """Fill up by weight, stop sources that overflow, give the excess to the others."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= most * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= most * sizes[s]
        open_ -= over
    return out


def make(spark, rows):
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA)
    for name in ("size", "target", "taken", "_part", "_key", "_rank", "_hash"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(400):
        source = rng.choice(["web"] * 12 + ["books", "code", "Ä", "b", None, "tiny"])
        out.append((i, " ".join("w" * rng.randint(1, 6) for _ in range(rng.choice([0, 1, 5, 40, 300]))), source))
    return out + [(400, None, "web"), (401, "", "empty"), (402, None, "none"), (None, "no id here", "web"), (7, "again an id", "web"), (7, "again an id", "web"), (403, "x " * 3000, "books")]


def test_matches_brute_force(spark, rows):
    got = mixing.mix_sources(make(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = targets_by_the_book(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-12, abs_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.epochs * r.size + r.extra
        taken[r.source] += r.taken
    assert {s: taken[s] for s in sizes} == {s: round(want[s]) for s in sizes}
    assert abs(sum(taken.values()) - sum(sizes.values())) <= len(sizes)
    # In order of their keys documents give all, then one gives a part, then none.
    by_source = defaultdict(list)
    for r in got:
        if r.doc_id is not None:
            u = (int(hashlib.sha256(f"13:{r.doc_id}".encode()).hexdigest()[:12], 16) + 1) / 2**48
            text = next(t for i, t, _ in rows if i == r.doc_id and len((t or "").split()) == r.size) or ""
            letters = len(re.sub(r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", "", text))
            by_source[r.source].append((-math.log(u) / max(0.01, letters / len(text) if text else 0), r.extra, r.size))
    for own in by_source.values():
        own = [(k, e, n) for k, e, n in sorted(own) if n]
        state = [2 if e == n else 1 if e else 0 for _, e, n in own]
        assert state == sorted(state, reverse=True) and state.count(1) <= 1


def test_reruns_agree(spark, rows):
    docs = make(spark, rows)
    once, again = (sorted(map(repr, mixing.mix_sources(d).collect())) for d in (docs, docs.repartition(7).orderBy(F.rand(3))))
    assert once == again


def test_sources_stop_one_after_the_other(spark):
    sizes = {"a": 1, "b": 50, "c": 3, "d": 1000, "e": 2, "f": 0, "g": 9, None: 400}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = targets_by_the_book(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-12) for s in want)
    half = {r.source: r.target for r in mixing.source_targets(df, (1, 1), 0.5).collect()}
    assert math.isclose(sum(half.values()), sum(sizes.values()) / 2, rel_tol=1e-3)
    with pytest.raises(ValueError):
        mixing.source_targets(df, share=4.0)


def test_better_documents_come_first_more_often(spark):
    rows = [(i, "word " * 10, "a") for i in range(2000)] + [(i, "word " * 10, "b") for i in range(2000, 2400)]
    docs = make(spark, rows)
    got = mixing.mix_sources(docs, quality=F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0), weights=(1, 3)).where("source = 'a'").collect()
    good, poor = (sum(r.extra > 0 for r in got if r.doc_id % 2 == k) for k in (0, 1))
    assert good + poor > 300 and good > 1.3 * poor


def test_running_totals_of_one_large_group(spark):
    df = spark.range(5000).select(F.lit("g").alias("g"), F.col("id").alias("o"), F.lit(1).alias("v"))
    got = mixing.running_totals(df, ["g"], [F.col("o")], {"t": F.col("v")}, "test").collect()
    assert all(r.t == r.o + 1 for r in got) and len(got) == 5000


def test_texts_of_the_mix(spark):
    rows = [(i, f"  a{i} b\tc\nd  ", "ab"[i % 5 == 0]) for i in range(30)] + [(99, "", "a")]
    docs = make(spark, rows)
    mix = mixing.mix_sources(docs, weights=(1, 4))
    taken, words = {r.doc_id: r.taken for r in mix.collect()}, defaultdict(int)
    for r in mixing.mixed_texts(docs, mix).collect():
        words[r.doc_id] += len(r.text.split())
        assert r.text and dict((i, t) for i, t, _ in rows)[r.doc_id].startswith(r.text)
    assert {i: n for i, n in taken.items() if n} == dict(words)


def test_empty_tables_and_texts(spark):
    assert mixing.mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mixing.mix_sources(make(spark, [(1, None, "a"), (2, " ", "b"), (3, "", None)])).collect()
    assert {(r.size, r.source_size, r.target, r.taken) for r in got} == {(0, 0, 0.0, 0)}
