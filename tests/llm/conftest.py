import random
import string

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(spark, rows):
    """documents with columns whose names clash with those that operators use inside."""
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    df = spark.createDataFrame(full, SCHEMA)
    for name in ("id", "kept", "_salt", "score", "row", "n", "_lost", "__slot", "__word", "__bits", "__may", "__row", "__hit", "_key", "h"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, shared lines and passages, empty, blank, null, long and odd texts."""
    rng = random.Random(11)
    words = ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 7))) for _ in range(400)]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    shared = text(60)
    line = "This line is found in Many documents."
    rows = []
    for i in range(60):
        rows.append((i, text(rng.randint(1, 120)) + "\n" + (line if i % 3 else text(5)) + "\n" + (shared if i % 10 == 0 else "")))
    base = text(90)
    for i in range(60, 90):
        own = base.split()
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join(own)))
    rows += [(i, rows[5][1]) for i in range(90, 97)]
    rows += [(97, None), (98, ""), (99, " \t\n "), (100, "one"), (101, "One"), (102, "two words"), (103, text(4000)), (104, "é  x ﬁ\r\nÀÉ"), (105, "\n\n")]
    rows += [(None, "a text with no id at all, but of some length"), (7, rows[7][1])]
    return rows
