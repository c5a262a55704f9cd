import hashlib
import random
from collections import defaultdict

import numpy as np

from kindred.llm.line_dedup import CuckooFilter, LineIndex, dedup_lines

from .conftest import SCHEMA, make_docs


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows):
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(-1 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 20 or len(held[key(x)]) < 3 or max(held[key(x)]) == (-1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()), key=str)


def test_lines_match_brute_force(spark, corpus):
    want = brute(corpus)
    assert rows_of(dedup_lines(make_docs(spark, corpus))) == want
    assert sum(n for _, _, n, _ in want) > 20


def test_no_rows(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_insertions_and_deletions_are_reversible(spark, corpus):
    rows = [r for r in corpus if r[0] is not None][:-1]
    first, second = make_docs(spark, rows[:50]), make_docs(spark, rows[50:])
    index = LineIndex(spark).insert(first).insert(second)
    assert rows_of(index.apply(make_docs(spark, rows))) == brute(rows)
    index.delete(second)
    assert rows_of(index.apply(first)) == brute(rows[:50])


def test_unknown_deletions_and_second_insertions_change_nothing(spark):
    line = "a line of more than twenty characters"
    rows = [(i, line) for i in (1, 2, 3, 9)]
    one, rest = make_docs(spark, rows[3:]), make_docs(spark, rows[:3])
    index = LineIndex(spark).insert(rest).delete(one).insert(one)
    assert rows_of(index.apply(make_docs(spark, rows))) == brute(rows)
    index.insert(one).insert(one).delete(one)
    assert rows_of(index.apply(rest)) == brute(rows[:3])
    index.delete(one).delete(make_docs(spark, [(3, line), (3, "another line that no document holds")]))
    assert rows_of(index.apply(make_docs(spark, rows[:2]))) == brute(rows[:2])
    assert index.counts.count() == 0


def test_deletion_from_an_empty_index(spark):
    line = "a line of more than twenty characters"
    docs = make_docs(spark, [(i, line) for i in range(4)])
    assert rows_of(LineIndex(spark).delete(docs).insert(docs).apply(docs)) == brute([(i, line) for i in range(4)])


def test_filters_grow_with_the_keys(spark, corpus, monkeypatch):
    from kindred.llm import line_dedup

    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 4)
    rows = [(i, "\n".join(f"line number {j} of them all, repeated" for j in range(i, i + 20))) for i in range(40)]
    index = LineIndex(spark).insert(make_docs(spark, rows[:5]))
    few = index.shards
    for lo in range(5, 40, 7):
        index.insert(make_docs(spark, rows[lo : lo + 7]))
    assert index.shards > few
    assert rows_of(index.apply(make_docs(spark, rows))) == brute(rows)


def test_a_null_id_is_a_document_below_all_others(spark):
    line = "a line of more than twenty characters"
    rows = [(None, line), (1, line), (2, line), (None, line + "\nx")]
    index = LineIndex(spark).insert(make_docs(spark, rows[:2])).insert(make_docs(spark, rows[2:]))
    assert rows_of(index.apply(make_docs(spark, rows))) == brute(rows)


def test_cuckoo_filter_holds_forgets_and_grows():
    rng = random.Random(1)
    keys = np.array([rng.getrandbits(64) for _ in range(5000)], np.uint64)
    f = CuckooFilter.from_bytes(CuckooFilter.build(keys).to_bytes())
    assert f.has(keys).all()
    others = np.array([rng.getrandbits(64) for _ in range(20_000)], np.uint64)
    assert f.has(others).mean() < 0.01
    assert all(f.remove(k) for k in keys[:2500].tolist())
    assert f.has(keys[2500:]).all() and f.has(keys[:2500]).mean() < 0.01
    small = CuckooFilter(1)
    added = [k for k in keys[:50].tolist() if small.add(k)]
    assert len(added) < 50 and small.has(np.array(added, np.uint64)).all()
