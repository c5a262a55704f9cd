import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from kindred.llm import queries
from kindred.llm.quality import score_quality

from .conftest import make_docs
from .test_decontaminate import brute as hits
from .test_ngram_join import brute as near
from .test_tokens import check_packed


@pytest.fixture(scope="module")
def sf_dir(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [r for r in corpus if r[0] is not None][:-1] + [(200 + i, " ".join(f"W{i}X{j}!!" for j in range(40))) for i in range(20)]
    make_docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < 200), 0) for i, _ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, rows[3][1])], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    good = {r.doc_id for r in score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect() if r.score >= 0.3}
    by_text = defaultdict(list)
    for i in good:
        by_text[rows[i] or ""].append(i)
    kept = [max(ids) for ids in by_text.values()]
    kept = sorted({c for _, c in near([(i, rows[i]) for i in kept], 5, 80).values()})
    kept = [i for i, (_, h, _) in hits([(i, rows[i]) for i in kept], items).items() if not h]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*library.encode(rows[i] or "", add_special_tokens=False).ids, 2], "<u4") for i in kept}
    check_packed(corpus_pipeline.run(spark, sf_dir).collect(), ids, 4096)
    assert len(good) < len(rows) and 3 not in kept and 0 < len(kept) < len(good)


def test_stages_return_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def written(spark, path, rows, labels, items=()):
    make_docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_nulls_repeats_and_empty_texts_pass_all_stages(spark, tmp_path):
    long = [" ".join(f"{x}{i}" for i in range(40)) for x in "abcd"]
    near = " ".join([*long[1].split()[:-1], "other"])
    rows = [
        (None, long[0]), (4, long[0]), (None, None), (5, ""), (6, long[1]), (7, near), (8, long[2]), (8, long[2]), (8, "a text of its own"), (None, long[3]), (9, f"so {long[3]}"),
    ]
    path = written(spark, str(tmp_path), rows, [], [(1, long[3])])
    got = corpus_pipeline.run(spark, path).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    # Equal texts: the largest id; near copies: the smallest; rows with the benchmark's passage go, whatever their id.
    kept = [(4, long[0]), (5, ""), (6, long[1]), (8, long[2]), (8, "a text of its own")]
    want = sorted((i, len(library.encode(t, add_special_tokens=False).ids) + 1) for i, t in kept)
    tokens = defaultdict(int)
    for r in got:
        tokens[r.doc_id] += r.length
    assert sorted({r.doc_id for r in got}) == [4, 5, 6, 8]
    assert sum(tokens.values()) == sum(n for _, n in want) and tokens[8] == sum(n for i, n in want if i == 8)


def test_empty_tables_pass_all_stages(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, str(tmp_path), [], [])).count() == 0


def test_every_operator_has_a_query():
    assert sorted({int(n[2:].split("_")[0]) for n in queries.QUERIES}) == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)
    assert zlib.crc32(b"") == 0
