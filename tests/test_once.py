"""Features evaluate their tokens once, and the kernels give what the single functions do."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import features as fx
from kindred.functions import hashing
from kindred.operators import lsh, minhash


@pytest.mark.parametrize("make", [lambda t: fx.word_shingles(t, 3), lambda t: fx.code_shingles(t, 5), lambda t: fx.char_shingles(t, 4), lambda t: fx.text_shingles(t, 3)])
def test_tokens_are_evaluated_once_in_a_plan(spark, make):
    plan = spark.range(1).select(F.col("id").cast("string").alias("t")).select(make(F.col("t")).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") + plan.count("regexp_replace(") <= 2


def test_windows_of_few_and_null_tokens(spark):
    rows = spark.createDataFrame([(None,), ([],), (["a"],), (["a", "b"],), (["a", "b", "c"],), (["a", None, "c", "d", "e"],)], "t array<string>")
    joined = ["".join(("a", "\x1f", "b"))]
    assert [r[0] for r in rows.select(fx.windows(F.col("t"), 2)).collect()] == [None, [], ["a"], joined, ["a\x1fb", "b\x1fc"], ["c\x1fd", "d\x1fe"]]


@pytest.mark.parametrize("width", [32, 64])
def test_signatures_of_short_and_long_sets(width):
    lengths = np.array([0, 1, hashing.LONG - 1, hashing.LONG, 0, hashing.PIECE, hashing.PIECE + 1, 5])
    flat = [b"f%d" % i for i in range(lengths.sum())]
    got, at, top = hashing.signatures(flat, lengths, 7, 3, width), 0, (1 << width) - 1
    a, b = hashing.permutations(7, 3, width)
    for row, n in zip(got, lengths, strict=True):
        h = hashing.hashes(flat[at : at + n], width).tolist() if n else []
        assert row.tolist() == [min([(x * p + q) & top for x in h], default=top) for p, q in zip(a, b, strict=True)]
        at += n
    assert int.from_bytes(hashlib.sha1(b"f0").digest()[:4], "little") >= 0


def test_signing_cuts_text_from_its_buffer(spark):
    rows = spark.createDataFrame([(0, ["é", "", "日本"]), (1, None), (2, []), (3, ["z"] * 60)], "k long, f array<string>")
    got = {r.k: r.signature for r in minhash.sign(rows, "k", F.col("f"), 5).collect()}
    for r in rows.collect():
        own = [f.encode() for f in r.f or []]
        assert got[r.k] == hashing.signatures(own, np.array([len(own)]), 5, 1, 32)[0].tolist()


def test_published_band_hashes_in_batches(spark):
    rows = spark.createDataFrame([(k, [(k * 977 + i * 31) % (1 << 32) for i in range(6)]) for k in range(50)], "k long, signature array<long>")
    own = {r.k: r.signature for r in rows.collect()}
    found = lsh.band_rows(rows, "k", 2, 3, published=True)
    assert {(r.key, r.band, r.bucket & hashing.M64) for r in found.collect()} == {(k, i, hashing.band_hash(v[3 * i : 3 * i + 3])) for k, v in own.items() for i in range(2)}
    assert "UDF" in found._jdf.queryExecution().optimizedPlan().toString()
    assert lsh.band_rows(rows.where("k < 0"), "k", 2, 3, published=True).count() == 0
