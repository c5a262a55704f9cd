import re

import numpy as np
import pytest

from kindred.llm.decontaminate import contamination, drop_contaminated, winnow

from .conftest import SCHEMA, make_docs


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))


def brute(rows, items, window=10):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[j : j + n]), set()).add(i)
    out = {}
    for i, t in rows:
        w = words(t)
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in wins}:
            for j in range(len(w) - n + 1):
                if own := wins.get(tuple(w[j : j + n])):
                    found |= own
                    hit[j : j + n] = [True] * n
        out[i] = len(w), sum(hit), sorted(found)
    return out


@pytest.fixture(scope="module")
def items(corpus):
    texts = [corpus[10][1], " ".join(corpus[3][1].split()[2:14]), "nothing of this is anywhere else here to be found at all", "two words", None, "", "!!", corpus[61][1]]
    return [*enumerate(texts), (0, texts[0])]


@pytest.mark.parametrize("index_bytes", [1 << 20, 0])
def test_hits_match_brute_force(spark, corpus, items, index_bytes):
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [r for r in corpus if r[0] is not None]
    got = contamination(make_docs(spark, rows), bench, index_bytes=index_bytes).collect()
    want = brute(rows, items)
    assert {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in got} == want
    assert any(h for _, h, _ in want.values())


@pytest.mark.parametrize("index_bytes", [1 << 20, 0])
def test_clean_documents_stay(spark, corpus, items, index_bytes):
    docs = make_docs(spark, corpus)
    bench = spark.createDataFrame(items, "item_id long, text string")
    hit = {i for i, (_, h, _) in brute(corpus, items).items() if h}
    kept = drop_contaminated(docs, bench, index_bytes=index_bytes)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in corpus if i not in hit)


def test_empty_tables(spark, corpus):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in contamination(make_docs(spark, corpus), none).collect()} == {0}
    assert contamination(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_winnowing_guarantee():
    rng = np.random.default_rng(2)
    for _ in range(300):
        x = rng.integers(0, 9, int(rng.integers(1, 60))).astype(np.uint64)
        window = int(rng.integers(1, 9))
        at = set(winnow(x, window).tolist())
        for j in range(max(1, len(x) - window + 1)):
            part = x[j : j + window]
            assert {j + int(i) for i in np.flatnonzero(part == part.min())} <= at


@pytest.mark.parametrize("window", [3, 10])
def test_both_ways_give_the_same_rows_for_random_texts(spark, window):
    """Few words, so that passages repeat, overlap and stand at the ends of texts."""
    rng = np.random.default_rng(8)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 4, n))
    items = [(i, text(int(rng.integers(0, 25)))) for i in range(25)] + [(90, "w1 " * 40), (91, "w1 " * 40)]
    rows = [(i, text(int(rng.integers(0, 120)))) for i in range(60)] + [(900, "w1 " * 60), (901, items[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items, window)
    for size in (1 << 20, 0):
        got = contamination(make_docs(spark, rows), bench, window=window, index_bytes=size).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in got} == want
