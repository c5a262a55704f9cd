import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from kindred.errors import ConfigurationError
from kindred.functions import features as fx
from kindred.functions import hashing


def one(spark, expr, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'array<string>'}" for k, v in columns.items()))
    return df.select(expr).first()[0]


SEP = fx.JOINER


@pytest.mark.parametrize(
    ("text", "size", "want"),
    [
        ("The quick, brown FOX jumps", 2, ["the quick", "quick brown", "brown fox", "fox jumps"]),
        ("one two", 3, ["one two"]),
        ("...!", 3, []),
        ("a b a b a b", 2, ["a b", "b a"]),
        ("", 2, []),
        ("Straße x", 1, ["strasse", "x"]),
    ],
)
def test_word_shingles(spark, text, size, want):
    for general in (False, True):
        assert one(spark, fx.word_shingles(F.col("t"), size, general=general), t=text) == [w.replace(" ", SEP) for w in want]


def test_other_shingles(spark):
    assert one(spark, fx.char_shingles(F.col("t"), 3), t="Abcd") == ["abc", "bcd"]
    assert one(spark, fx.char_shingles(F.col("t"), 3), t=" a \n b ") == ["a b"]
    assert one(spark, fx.char_shingles(F.col("t"), 5), t="ab") == ["ab"]
    assert one(spark, fx.char_shingles(F.col("t"), 2, normalize=False), t="A  b") == ["A ", "  ", " b"]
    assert one(spark, fx.char_shingles(F.col("t"), 2), t="  ") == []
    assert one(spark, fx.word_shingles(F.col("t"), 1, normalize=False), t=" A,\tb\xa0c ") == ["A,", "b", "c"]
    assert one(spark, fx.text_shingles(F.col("t"), 2), t="a b a b") == [f"a{SEP}b", f"b{SEP}a", f"a{SEP}b"]
    assert one(spark, fx.text_shingles(F.col("t"), 2), t="!") == [""]
    assert one(spark, fx.word_shingles(F.col("t"), 2), t=None) is None
    with pytest.raises(ConfigurationError):
        fx.word_shingles(F.col("t"), 0)


def test_general_folding_is_nfkc_and_casefold(spark):
    for t in ("ﬁX Ⅷ ẞ Σς", "Ａｂ"):
        want = re.findall(r"\w+", unicodedata.normalize("NFKC", t).casefold())
        assert one(spark, fx.words(F.col("t"), general=True), t=t) == want


def test_code_tokens(spark):
    text = "x_1 = 0xFf + 1_000.5e-3 >>= 'a\\'b' \"c\r\nd\" != é2 == .5 0b10 a->b"
    want = ["x_1", "=", "<number>", "+", "<number>", ">>=", "<string>", "<string>", "!=", "é2", "==", "<number>", "<number>", "a", "->", "b"]
    assert one(spark, fx.code_tokens(F.col("t")), t=text) == want
    assert one(spark, fx.code_shingles(F.col("t"), 2), t="a b a b") == [f"a{SEP}b", f"b{SEP}a", f"a{SEP}b"]
    assert one(spark, fx.code_shingles(F.col("t"), 2), t=" ") == []


def test_entity_profiles(spark):
    got = one(spark, fx.customer_features(F.col("n"), F.col("a"), F.col("e"), F.col("p")), n="Ann Li", a="1 High St", e=" A@B.org ", p="+44 (20) 1234-56789")
    assert got == sorted({
        "name:word:ann", "name:word:li", *("name:gram:" + g for g in ("^an", "ann", "nn ", "n l", " li", "li$")), "address:word:1", "address:word:high",
        "address:word:st", "email:exact:a@b.org", "email:domain:b.org", "phone:exact:0123456789",
    })
    got = one(spark, fx.product_features(F.col("t"), F.col("b"), F.col("s"), F.col("c")), t="Big Box", b="A-B c", s=None, c="box")
    assert got == ["brand:exact:abc", "category:word:box", "title:word:big", "title:word:box"]
    assert one(spark, fx.customer_features(F.col("n"), F.col("n"), F.col("n"), F.col("n")), n=None) == []
    with pytest.raises(Exception, match="no usable features"):
        one(spark, fx.require_features(fx.words(F.col("t"))), t="!")


def test_similarities(spark):
    assert one(spark, fx.jaccard(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z"]) == pytest.approx(1 / 3)
    assert one(spark, fx.jaccard(F.col("a"), F.col("b")), a=[], b=[]) == 1.0
    assert one(spark, fx.signature_similarity(F.col("a"), F.col("b")), a=["1", "2"], b=["1", "3"]) == 0.5
    assert one(spark, fx.signature_similarity(F.col("a"), F.col("b")), a=["1"], b=["1", "3"]) == 0.0


def test_golden_hashes(spark):
    assert one(spark, hashing.sha1_hash32(F.col("t")), t="hello") == 499578026
    assert int(one(spark, hashing.sha1_hash64(F.col("t")), t="hello")) == 11738849977924252842
    for t in ("hello", "x", ""):
        h = int.from_bytes(hashlib.sha1(t.encode()).digest()[:4], "little")
        assert one(spark, hashing.fmix32(hashing.sha1_hash32(F.col("t"))), t=t) == int(hashing.hashes([t.encode()], 32)[0])
        assert one(spark, hashing.sha1_hash32(F.col("t")), t=t) == h


def test_golden_permutations_and_signatures():
    a, b = hashing.permutations(8, 42)
    assert list(a) == [803958421, 2993090819, 319790931, 239788949, 608707571, 1015077639, 1161260381, 2661167013]
    assert list(b) == [188579285, 696219566, 2002459071, 1159090366, 2134787814, 1206742455, 48729820, 1299985394]
    import numpy as np

    got = hashing.signatures([b"a", b"b", b"c"], np.array([3]), 8, 42, 32)[0].tolist()
    assert got == [555478325, 368287343, 517307743, 440211845, 1088094199, 1274094295, 904708659, 327688530]
    got = hashing.signatures([b"a", b"b", b"c"], np.array([0, 3, 0]), 8, 42, 64).tolist()
    assert got[1] == [
        398824617996340472, 4985036841737875763, 430169245876064069, 4830488362799227617, 9007712658965612972, 6350542169249656984,
        14245705141267314417, 3755630306339185935,
    ]
    assert got[0] == got[2] == [hashing.M64] * 8
    with pytest.raises(ConfigurationError):
        hashing.permutations(0, 1)


def test_code_tokens_of_compatibility_characters(spark):
    rows = spark.createDataFrame([("ｘ１ = ﬁ",), ("a = 1",), (None,)], "t string")
    got = [r.v for r in rows.select(fx.code_tokens(F.col("t"), general=True).alias("v")).collect()]
    assert got == [["x1", "=", "fi"], ["a", "=", "<number>"], None]


def test_character_shingles_of_long_and_odd_texts(spark):
    texts = ["a😀b😀c\n?x" * 3, "x" * 200_000 + "yz", "\ud7ff\ue000\U0010ffff" * 2, "ab"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(fx.char_shingles(F.col("t"), 3, normalize=False).alias("v")).collect()
    for t, r in zip(texts, rows, strict=True):
        assert r.v == (list(dict.fromkeys(t[i : i + 3] for i in range(len(t) - 2))) if len(t) > 3 else [t])
