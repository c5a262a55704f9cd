import random
import zlib

from kindred.llm.quality import features, score_quality

from .conftest import make_docs


def test_texts_of_like_shape_are_told_by_their_words(spark):
    rng = random.Random(2)
    good, bad = ["river", "moon", "stone", "walk", "green"], ["casino", "pills", "winner", "cheap", "click"]
    rows, labels = [], []
    for i in range(400):
        own = bad if i % 3 == 0 else good
        words = [rng.choice(own)]
        while len(words) < 20:
            if (w := rng.choice(own)) != words[-1]:
                words.append(w)
        rows.append((i, " ".join(words)))
        labels.append((i, int(own is good), 0))
    got = score_quality(make_docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [r for r in got if r.held_out]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert sum(r.predicted == (r.doc_id % 3 > 0) for r in held) >= 0.97 * len(held)


def test_long_shapes_are_not_cut():
    assert set(features("a1b2c3d4e5")) != set(features("a1b2c3d4%%"))
