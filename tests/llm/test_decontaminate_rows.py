import pytest

from kindred.llm.decontaminate import contamination, drop_contaminated

from .conftest import make_docs


@pytest.mark.parametrize("index_bytes", [1 << 20, 0])
def test_rows_with_null_or_repeated_ids_are_judged_by_themselves(spark, index_bytes):
    a, b = (" ".join(f"{x}{i}" for i in range(12)) for x in "ab")
    rows = [(None, a), (None, "clean"), (7, a), (7, f"so {b}"), (7, "clean too"), (8, None)]
    bench = spark.createDataFrame([(1, a), (2, b)], "item_id long, text string")
    got = contamination(make_docs(spark, rows), bench, index_bytes=index_bytes).collect()
    have = sorted((str(r.doc_id), r.n_words, r.n_hit, [(s.start, s.end) for s in r.spans], sorted(r["items"])) for r in got)
    want = [(None, 12, 12, [(0, 12)], [1]), (None, 1, 0, [], []), (7, 12, 12, [(0, 12)], [1]), (7, 13, 12, [(1, 13)], [2]), (7, 2, 0, [], []), (8, 0, 0, [], [])]
    assert have == sorted((str(i), *x) for i, *x in want)
    kept = drop_contaminated(make_docs(spark, rows), bench, index_bytes=index_bytes).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == [("7", "clean too"), ("8", ""), ("None", "clean")]
