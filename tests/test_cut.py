"""Word shingles that are cut and hashed where they are signed."""

import random

import numpy as np
from pyspark.sql import functions as F

from kindred.functions import features as fx
from kindred.functions import hashing
from kindred.operators import minhash

TEXTS = [
    None, "", " ", "a", "--a", "a b", "One, two three", "x_1  y2\n\nz3!", "Straße ÉTÉ   dø–re «quoted» ½ x", "日本語 テキスト、四 五", "İstanbul KK ﬁ Á b",
    "nul\x00between\x1fthese\x85and those", "word " * 40, "w" * 30 + " " + "v" * 30 + " é" * 9, "𝒳𝒴 😀 𐐀 a", "e1 é2 e3 é4 e5 é6", "z" * 200,
]


def test_pieces_hash_as_the_library_does():
    rng = random.Random(1)
    own = [rng.randbytes(n) for n in [0, 1, 3, 4, 54, 55, 56, 57, 63, 64, 65, 119, 120] * 3 + [20] * 9000]
    lengths = np.array([len(x) for x in own])
    data = np.frombuffer(b"".join(own) + bytes(64), np.uint8)
    for width in (32, 64):
        assert hashing.cut_hashes(data, np.cumsum(lengths) - lengths, lengths, width).tolist() == hashing.hashes(own, width).tolist()


def test_signatures_of_texts_are_those_of_their_shingles(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "key long, text string").coalesce(1)
    for size, width in ((1, 32), (2, 64), (3, 32), (5, 64)):
        form = fx.WordShingles(F.col("text"), size)
        found = {r.key: r.signature for r in minhash.sign(rows, "key", form, 24, 3, width).collect()}
        assert found == {r.key: r.signature for r in minhash.sign(rows, "key", form.column, 24, 3, width).collect()}
        assert len(found) == len(TEXTS)


def test_no_object_of_a_shingle_is_made(monkeypatch):
    """A short shingle is hashed in an array with others."""

    def refused(_):
        raise AssertionError("hashed by itself")

    data = b"one two three four five" * 100
    packed, at, lengths, counts = fx.cut_shingles(np.frombuffer(data, np.uint8), np.array([len(data)]), 3)
    monkeypatch.setattr(hashing, "sha1", refused)
    assert len(hashing.cut_hashes(packed, at, lengths, 32)) == counts.sum() == 399
