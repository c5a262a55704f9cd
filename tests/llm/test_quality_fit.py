"""The classifier against naive Bayes support vectors by the book: grams as strings, ratios by counting, the hinge loss to its minimum."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from kindred.llm.quality import SAMPLE_ROWS, features, fit, score_quality

from .conftest import make_docs


def grams(text):
    """Distinct 1- to 3-grams of lower-cased words and of their shapes, each marked if it repeats the word before."""
    words = text.split()
    kind = lambda c: "A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" or ord(c) > 127 else "0" if c.isdigit() else c
    shapes = [re.sub(r"(.)\1+", r"\1", "".join(map(kind, w))) + ("+" if i and words[i - 1] == w else "") for i, w in enumerate(words)]
    out = set()
    for tag, own in (("s", shapes), ("w", [w.lower() for w in words])):
        out |= {(tag, *own[i : i + n]) for n in (1, 2, 3) for i in range(len(own) - n + 1)}
    return out


def corpus(n=160):
    rng = random.Random(15)
    rows = []
    for i in range(n):
        good = i % 3 > 0
        own = [rng.choice(["the", "of", "moon", "Rain", "walk", "river,"] + (["stone", "blue."] if good else ["cash", "WIN!!"])) for _ in range(rng.randint(1, 25))]
        rows.append((" ".join(own), int(good)))
    return rows


def test_indicators_are_the_grams_of_words_and_shapes():
    for text, _ in corpus(40):
        assert len(features(text)) == len(grams(text))
    assert set(features("Rain")) & set(features("rain")) and set(features("Rain")) != set(features("rain"))


def test_the_fit_reaches_the_minimum_by_the_book():
    rows = corpus()
    n = len(rows)
    labels = np.array([y for _, y in rows])
    held = set(np.random.default_rng(7).permutation(n)[: n // 5].tolist())
    train = [i for i in range(n) if i not in held]
    sets = [sorted(grams(t)) for t, _ in rows]
    names = _names(sets, rows)
    good, bad = Counter(), Counter()
    for i in train:
        (good if labels[i] else bad).update(sets[i])
    size = 1 << 18
    ratio = {g: math.log((good[g] + 1) / (sum(good.values()) + size)) - math.log((bad[g] + 1) / (sum(bad.values()) + size)) for own in sets for g in own}
    x = [{g: ratio[g] / math.sqrt(max(1, len(own))) for g in own} for own in sets]
    y = [1 if v else -1 for v in labels]
    share = sum(labels[i] for i in train)
    cost = [len(train) / (2 * share) if v else len(train) / (2 * (len(train) - share)) for v in labels]

    def loss(w, b):
        return 0.5 * (sum(v * v for v in w.values()) + b * b) + sum(cost[i] * max(0.0, 1 - y[i] * (sum(w.get(g, 0.0) * v for g, v in x[i].items()) + b)) for i in train)

    # Dual coordinate descent until nothing moves, in the order of the rows.
    w, b, alpha = Counter(), 0.0, [0.0] * n
    for _ in range(400):
        moved = 0.0
        for i in train:
            g = y[i] * (sum(w[k] * v for k, v in x[i].items()) + b) - 1
            new = min(max(alpha[i] - g / (sum(v * v for v in x[i].values()) + 1), 0.0), cost[i])
            step, alpha[i] = new - alpha[i], new
            for k, v in x[i].items():
                w[k] += step * y[i] * v
            b += step * y[i]
            moved = max(moved, abs(step))
        if moved < 1e-9:
            break
    least = loss(w, b)
    model = fit([features(t) for t, _ in rows], labels)
    fitted = {g: model.weights[names[g]] / ratio[g] for g in ratio if abs(ratio[g]) > 1e-12}
    assert least <= loss(fitted, model.bias) <= 1.03 * least + 0.05
    book = [sum(w[k] * v for k, v in own.items()) + b for own in x]
    ours = [sum(model.weights[names[g]] for g in own) / math.sqrt(max(1, len(own))) + model.bias for own in sets]
    assert np.corrcoef(book, ours)[0, 1] > 0.995


def _names(sets, rows):
    """The bucket of each gram: that which a text of this gram alone has and its shorter grams don't, found by elimination."""
    where: dict = {}
    for own, (text, _) in zip(sets, rows, strict=True):
        found = set(features(text).tolist())
        for g in own:
            where[g] = where.get(g, found) & found
    for own, (text, _) in zip(sets, rows, strict=True):
        found, own = set(features(text).tolist()), set(own)
        for g in where:
            if g not in own:
                where[g] = where[g] - found
    # Grams that occur in the same texts alone can't be told apart, and need not be: they have equal weights.
    assert all(where.values())
    return {g: min(v) for g, v in where.items()}


def test_the_sample_is_bounded_and_repeats_teach_once(spark):
    rows = [(i, t) for i, (t, _) in enumerate(corpus())]
    labels = spark.createDataFrame([(i, y, 0) for i, (_, y) in enumerate(corpus())], "doc_id long, quality int, toxic int")
    once = {r.doc_id: r.score for r in score_quality(make_docs(spark, rows), labels).collect()}
    twice = {r.doc_id: r.score for r in score_quality(make_docs(spark, rows + rows), labels).collect()}
    assert once == twice and SAMPLE_ROWS == 20_000
    few = {r.doc_id: r.score for r in score_quality(make_docs(spark, rows), labels, sample_rows=40).collect()}
    assert len(few) == len(rows) and few != once
    several = score_quality(make_docs(spark, [*rows, *[(3, f"other {i}") for i in range(60)]]), labels, sample_rows=40).collect()
    assert len(several) == len(rows) + 60 and all(0 <= r.score <= 1 for r in several)


@pytest.mark.parametrize("text", ["", " ", "\n\t"])
def test_texts_without_words_have_no_indicators(text):
    assert len(features(text)) == 0
