import random
import re

import numpy as np
import pytest

from kindred.llm import ngram_join
from kindred.llm.common import components
from kindred.llm.ngram_join import Bands, drop_near_copies, jaccard_components, shingle_set, sketch

from .conftest import SCHEMA, make_docs


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        n = min(k, len(w))
        sets.setdefault(i, {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted((i for i in sets if i is not None))
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    a, b = find(x), find(y)
                    root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_components_match_brute_force(spark, corpus, k, percent):
    got = jaccard_components(make_docs(spark, corpus), k=k, percent=percent).collect()
    assert len(got) == len(corpus)
    want = brute(corpus, k, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_chains_and_families_near_the_threshold(spark, monkeypatch):
    """Copies that differ from each other by about the bound: many buckets hold several components."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 8)
    rng = random.Random(4)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = f"v{rng.randrange(10_000)}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(make_docs(spark, rows), k=3, percent=90).collect()}
    assert got == brute(rows, 3, 90)


def test_drop_keeps_one_of_each_group(spark, corpus):
    docs = make_docs(spark, [r for r in corpus if r[0] is not None][:-1])
    kept = drop_near_copies(docs)
    want = brute([r for r in corpus if r[0] is not None][:-1], 5, 80)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_no_rows(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_sketches_of_linked_sets_share_a_token_and_bound_the_difference(percent):
    rng, bands = np.random.default_rng(5), Bands(percent)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        drop = int(rng.integers(0, max(1, len(a) // 5) + 1))
        b = np.unique(np.concatenate((a[drop:], rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 8) + 1)), dtype=np.uint64))))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < percent * (len(a) + len(b) - both):
            continue
        at = bands.of(max(len(a), len(b)))
        tops = [dict(bands.joined(len(s)))[at] for s in (a, b)]
        (ta, pa_), (tb, pb) = sketch(a, at, tops[0], bands), sketch(b, at, tops[1], bands)
        assert set(ta.tolist()) & set(tb.tolist())
        differ = (int.from_bytes(pa_, "little") ^ int.from_bytes(pb, "little")).bit_count()
        assert differ <= len(a) + len(b) - 2 * both <= bands.most(len(a) + len(b))


def test_short_texts_are_one_shingle():
    assert len(shingle_set("a b", 3)) == 1 and len(shingle_set("", 3)) == 0 and len(shingle_set("a b c d", 3)) == 2


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 160)] + [(300, 301), (301, 300), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(21)} == {0} and {got[i] for i in range(100, 160)} == {100} and got[301] == 300


@pytest.mark.parametrize("percent", [69, 0, 101])
def test_thresholds_that_sketches_cannot_serve_are_refused(spark, percent):
    with pytest.raises(ValueError, match="within 70 and 100"):
        jaccard_components(make_docs(spark, [(1, "a b c")]), percent=percent)


def rows_by_the_book(rows, k, percent):
    """Smallest id of each row's component, rows being told apart by their place."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[j : j + min(k, len(w))]) for j in range(len(w) - min(k, len(w)) + 1)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                root[find(x)] = find(y)
    least = {}
    for i, (own, _) in enumerate(rows):
        if own is not None:
            least[find(i)] = min(own, least.get(find(i), own))
    return [(own, least.get(find(i))) for i, (own, _) in enumerate(rows)]


def test_rows_without_ids_carry_links(spark):
    words = [f"w{i}" for i in range(60)]
    other = [*words[:48], "x", "y", *words[50:]]
    a, n, b = (" ".join(w) for w in (words, other, [*other[:10], "v", "z", *other[12:]]))
    for middle in (7, None):
        rows = [(3, a), (middle, n), (9, b), (None, "alone " + b[::-1])]
        got = sorted(map(repr, ((r.doc_id, r.component_id) for r in jaccard_components(make_docs(spark, rows), k=3, percent=85).collect())))
        assert got == sorted(map(repr, rows_by_the_book(rows, 3, 85)))
        assert "(9, 3)" in got


def test_null_and_repeated_ids_match_brute_force(spark):
    rng = random.Random(8)
    families = [[f"f{f}w{rng.randrange(500)}" for _ in range(80)] for f in range(8)]
    rows = []
    for i in range(90):
        own = list(rng.choice(families))
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = f"v{rng.randrange(9999)}"
        rows.append((None if rng.random() < 0.4 else rng.randrange(40), " ".join(own)))
    rows += [(None, " ".join(families[0]))] * 3 + [(None, None), (None, "")]
    got = jaccard_components(make_docs(spark, rows), k=3, percent=90).collect()
    # Rows are told by id and text alone here, so equal pairs are counted.
    assert sorted(map(repr, ((r.doc_id, r.component_id) for r in got))) == sorted(map(repr, rows_by_the_book(rows, 3, 90)))
    kept = drop_near_copies(make_docs(spark, rows), k=3, percent=90).collect()
    want = rows_by_the_book(rows, 3, 90)
    gone = {own for own, c in want if own is not None and own != c}
    assert sorted(r.text or "" for r in kept) == sorted(t or "" for (own, t), (_, c) in zip(rows, want, strict=True) if own not in gone and (own is not None or c is None))
