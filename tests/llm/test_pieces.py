"""Rows between op4's steps hold short values, and values that were split come together again."""

from __future__ import annotations

import collections
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from kindred.llm import pitman_yor
from kindred.llm.pitman_yor import score_texts

from .conftest import make_docs


def test_rows_between_steps_hold_short_values(spark, monkeypatch):
    longest, moved = {}, []

    def watched(write):
        def run(df, name, *rest):
            if name == "seated":
                moved.append("ENSURE_REQUIREMENTS" in df._jdf.queryExecution().executedPlan().toString())
            table = write(df, name, *rest)
            for column, kind in table.dtypes:
                if kind == "binary":
                    most = table.agg(F.max(F.length(column))).first()[0] or 0
                    longest[name, column] = max(longest.get((name, column), 0), most)
            return table

        return run

    for name in ("shared_table", "bucketed_table"):
        monkeypatch.setattr(pitman_yor, name, watched(getattr(pitman_yor, name)))
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{int(20_000 * rng.random() ** 2)}" for _ in range(8000))) for i in range(40)]
    got = {r.doc_id: r for r in score_texts(make_docs(spark, rows)).collect()}
    assert longest["tokens", "cells"] and max(longest.values()) <= 1 << 16, longest
    assert not any(moved)  # the table of tokens stays where it is

    counts = collections.Counter()
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update([*text.split(), None])
    total, words = sum(counts.values()), len(counts)
    for i, text in rows:
        tokens = [*text.split(), None]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (words + 1))) for w in tokens)
        assert got[i].base_score == pytest.approx(base, abs=1e-6)
        assert (got[i].n_tokens, got[i].n_known) == (len(tokens), sum(counts[w] > 0 for w in tokens))
        assert got[i].train_tokens == total and got[i].score < 0
