import hashlib
from collections import defaultdict

from kindred.llm.exact_dedup import drop_exact_copies, exact_groups

from .conftest import SCHEMA, make_docs


def test_groups_match_brute_force(spark, corpus):
    got = exact_groups(make_docs(spark, corpus), digest=True).collect()
    assert len(got) == len(corpus)
    members = defaultdict(list)
    for i, t in corpus:
        members[t or ""].append(i)
    text_of = defaultdict(set)
    for i, t in corpus:
        text_of[i].add(t or "")
    for r in got:
        (text,) = text_of[r.doc_id]
        ids = members[text]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    # One row of each group stays, also where an id repeats.
    assert sum(r.kept for r in got) == len(members)


def test_kept_rows_and_columns_stay(spark, corpus):
    docs = make_docs(spark, corpus)
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({t or "" for _, t in corpus})


def test_no_rows(spark):
    assert exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    assert drop_exact_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_large_group(spark):
    got = exact_groups(make_docs(spark, [(i, "same") for i in range(500)])).collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(499, 500)} and sum(r.kept for r in got) == 1


def test_equal_prefix_and_length_are_not_enough(spark):
    a, b = "p" * 100 + "a", "p" * 100 + "b"
    got = {r.doc_id: r.group_size for r in exact_groups(make_docs(spark, [(1, a), (2, b), (3, a)])).collect()}
    assert got == {1: 2, 2: 1, 3: 2}
