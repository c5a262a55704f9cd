import hashlib
import re

import pytest
from pyspark.sql import functions as F

from kindred.llm import fill_middle as fim

from .conftest import SCHEMA, make_docs


def by_the_book(i, text, rate=100, first=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return i, n, "plain", None, None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < first:
        return i, n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


ODD = [
    (300 + k, t)
    for k, t in enumerate([
        "\x01\x02a\n\x01b\x02\n\x01a\x01\x01", "\x02", "\x02\x02\n\x02", "<\nS>\n<P", "<\n<\n<", "a <M> b\nc", "\r\r\n\x0b\x0c x\u0085\n", "🙂\n漢\n", "\n", "\n\n\n", "x" * 50_000,
        "\n".join(f"line {j} <" for j in range(3000)), "\x01b\n" * 40, "$0 \\ $1\n\\n",
    ])
] + [(400 + k, "a\nb\nc\n<\nd") for k in range(40)]


@pytest.mark.parametrize(("rate", "first"), [(100, 50), (40, 10), (0, 0), (100, 100)])
def test_matches_brute_force(spark, corpus, rate, first):
    rows = [*corpus, *ODD]
    got = fim.fill_in_middle(make_docs(spark, rows), rate=rate, suffix_first=first)
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(by_the_book(i, t, rate, first)) for i, t in rows)


def test_texts_come_back_whole(spark, corpus):
    rows = [(k, t) for k, (_, t) in enumerate([*corpus, *ODD])]
    for unit in (fim.LINES, fim.WORDS, fim.CHARACTERS):
        got = fim.fill_in_middle(make_docs(spark, rows), unit=unit).withColumn("text", fim.restored(F.col("output"), F.col("form")))
        assert {r.doc_id: r.text for r in got.collect()} == {k: t or "" for k, t in rows}


def test_other_units_cover_texts(spark):
    text = "  two  words\nand 🙂 more \n"
    got = {u: fim.fill_in_middle(make_docs(spark, [(1, text)]), unit=u).first() for u in (fim.WORDS, fim.CHARACTERS)}
    assert got[fim.WORDS].n == len(re.findall(r"\S*\s+|\S+", text)) and got[fim.CHARACTERS].n == len(text)
    assert all(r.prefix + r.middle + r.suffix == text for r in got.values())


def test_no_rows_and_wrong_markers(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0
    for wrong in (("<P>", "<P>", "<M>"), ("aa", "<S>", "<M>"), ("<P>", "[S]", "<M>"), ("<P", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fim.Markers(*wrong)
    own = fim.Markers("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>")
    r = fim.fill_in_middle(make_docs(spark, [(5, "a\nb\nc <P>")]), markers=own).first()
    assert r.form != "plain" and r.output.count("<|fim_middle|>") == 1
