import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kindred.llm import pitman_yor
from kindred.llm.pitman_yor import Restaurants, parent, perplexity, score_texts
from kindred.llm.quality import fit, keep_quality, score_quality

from .conftest import SCHEMA, make_docs


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")), None]


@pytest.mark.parametrize(("gather", "docs", "bucket", "look"), [(1 << 22, 1 << 16, 1 << 22, 64), (300, 7, 500, 1)])
def test_counts_and_base_match_brute_force(spark, corpus, gather, docs, bucket, look, monkeypatch):
    """With small chunks and buckets, frequent contexts are dealt over several buckets."""
    for name, value in (("GATHER", gather), ("GATHER_DOCS", docs), ("BUCKET_TOKENS", bucket), ("LOOK", look)):
        monkeypatch.setattr(pitman_yor, name, value)
    c = Counter()
    for i, t in corpus:
        if zlib.crc32(str(i).encode() if i is not None else b"") % 10:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    got = score_texts(make_docs(spark, corpus)).collect()
    assert len(got) == len(corpus)
    by = dict(corpus)
    for r in got:
        own = tokens(by[r.doc_id])
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(c[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(base, rel=1e-6) and r.score < 0
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 10 == 0)


def test_context_model_beats_the_base(spark):
    """Texts in which a word tells the next one: held-out perplexity must fall far below that of single words."""
    rng = random.Random(3)
    follow = {f"w{i}": [f"w{rng.randrange(200)}" for _ in range(2)] for i in range(200)}
    rows = []
    for i in range(300):
        own = [f"w{rng.randrange(200)}"]
        while len(own) < 60:
            own.append(rng.choice(follow[own[-1]]))
        rows.append((i, " ".join(own)))
    scored = score_texts(make_docs(spark, rows))
    model = {r.held_out: r.perplexity for r in perplexity(scored).collect()}
    base = {r.held_out: r.perplexity for r in perplexity(scored, "base_score").collect()}
    assert model[True] < 0.2 * base[True]


def test_seating_stays_whole_and_probabilities_add_up():
    rng = np.random.default_rng(1)
    room, base = np.repeat(np.arange(4), 30), np.full(120, 1 / 30)
    r = Restaurants(room, rng.integers(1, 90, 120), 4, (0.6, 3.0), rng)
    r.start(base)
    for _ in range(20):
        r.sweep(base)
        assert (np.bincount(r.cell, r.size, 120) == r.customers).all() and r.size.min() > 0
        assert (r.tables <= r.customers).all()
    own, rest = r.predictive()
    assert np.allclose(np.bincount(room, own, 4) + rest, 1)
    p = parent(np.array([9, 4, 1, 1, 0]), np.array([3, 2, 1, 1, 0]), 4, 15, 7)
    assert p.sum() == pytest.approx(1) and p[0] > p[1] > p[2] > p[4] > 0


def test_scoring_without_training_rows(spark):
    assert score_texts(spark.createDataFrame([], SCHEMA)).count() == 0
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    (r,) = score_texts(make_docs(spark, [(held, "a b")])).collect()
    assert (r.train_tokens, r.n_known, r.n_tokens) == (0, 0, 3) and math.isfinite(r.score) and math.isfinite(r.base_score)


def labelled(spark, n=400):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        own = [rng.choice(["the", "of", "moon", "Rain", "walk", "stone", "river,", "blue."]) for _ in range(rng.randint(3, 60))]
        if not good:
            own = rng.choice([[w.upper() + "!!" for w in own], [w + "&&&" for w in own], [own[0]] * (len(own) + 4), [x for w in own for x in (w, "|")]])
        rows.append((i, " ".join(own)))
        labels.append((i, int(good), 0))
    return rows, make_docs(spark, rows), spark.createDataFrame([*labels, (1, None, None), (None, 1, 0), (n + 5, 1, 0)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows, docs, labels = labelled(spark)
    got = {r.doc_id: r for r in score_quality(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.where("quality is not null").collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert {i for i in got if zlib.crc32(str(i).encode()) % 5 == 0} == set(held)
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    kept = keep_quality(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.predicted)


def test_labels_of_held_out_rows_teach_nothing(spark):
    _, docs, labels = labelled(spark, 200)
    other = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) as quality", "toxic")
    a = {r.doc_id: r.score for r in score_quality(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in score_quality(docs, other).collect()}


def test_no_labels_one_class_and_no_rows(spark, corpus):
    docs = make_docs(spark, corpus)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in score_quality(docs, none).collect()} == {0.5}
    assert len({r.score for r in score_quality(docs, spark.createDataFrame([(1, 1, 0)], none.schema)).collect()}) == 1
    assert score_quality(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_hinge_loss_separates():
    rows = [np.array([1, 5], np.int32)] * 20 + [np.array([2, 5], np.int32)] * 20
    model = fit(rows, np.array([1] * 20 + [0] * 20))
    assert model.score(rows[0]) > 0.7 > 0.3 > model.score(rows[-1])
