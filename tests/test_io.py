import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.errors import ConfigurationError, StorageError
from kindred.sources import readers, sinks


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_strict_json_lines(spark, tmp_path):
    good = write(tmp_path, "a.jsonl", '{"key":1,"values":["new york","rust"]}\n\n{"key":2,"signature":[1,2],"scheme":"affine32","seed":7}\n')
    rows = {r.key: r for r in readers.index_records(spark, good, num_perm=2, seed=7).collect()}
    assert rows[1]["values"] == ["new york", "rust"] and [int(x) for x in rows[2].signature] == [1, 2]
    for bad in (
        '{"key":1,"values":[],"other":2}', '{"key":1}', '{"key":1,"values":["a"],"signature":[1,2],"scheme":"affine32"}', '{"key":1,"signature":[1,2]}',
        '{"key":1,"signature":[1],"scheme":"affine32"}', '{"key":1,"signature":[1,4294967296],"scheme":"affine32"}', '{"key":1,"values":["a"],"seed":7}', "nope",
    ):
        with pytest.raises(Exception):  # noqa: B017
            readers.index_records(spark, write(tmp_path, "b.jsonl", bad), num_perm=2, seed=7).collect()


def test_documents(spark, tmp_path):
    rows = readers.documents(spark, write(tmp_path, "d.jsonl", '{"id":"a","text":"x"}\n{"id":5,"text":"y"}\n')).collect()
    assert {(r.id, r.text) for r in rows} == {("a", "x"), ("5", "y")}
    for bad in ('{"id":true,"text":"x"}', '{"id":1,"text":2}', '{"text":"x"}'):
        with pytest.raises(Exception):  # noqa: B017
            readers.documents(spark, write(tmp_path, "e.jsonl", bad)).collect()


def test_source_tree(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "a").mkdir(parents=True)
    (root / "a" / "x.py").write_text("print(1)")
    (root / "a" / "y.txt").write_text("no")
    (root / "b.py").write_bytes(b"a\0b")
    (root / "c.py").write_text(" ")
    (root / "d.py").write_text("z" * 100)
    found, fates = readers.source_tree(spark, str(root), (".py",), max_bytes=50)
    assert [(r.path, r.content) for r in found.collect()] == [("a/x.py", "print(1)")]
    counts = {r.fate: r.files for r in fates.collect()}
    assert counts == {"accepted": 1, "skipped_extension": 1, "skipped_binary": 1, "skipped_empty": 1, "skipped_oversize": 1}


def test_frames_sets_and_guards(spark, tmp_path):
    table = pa.table({"id": [1, 2, None], "x": [[1], None, [2, 3]]})
    assert readers.frame(spark, table, ["x"]).count() == 3
    assert readers.frame(spark, table.to_batches()[0]).columns == ["id", "x"]
    sets = readers.integer_sets(spark, write(tmp_path, "s.txt", "3 1 2 1\n\n7\n")).collect()
    assert sorted(tuple(r["items"]) for r in sets) == [(), (1, 2, 3), (7,)]
    rows = readers.csv(spark, write(tmp_path, "c.csv", "id,title\n1,a\n"), "id int, title string").collect()
    assert rows[0].title == "a"
    with pytest.raises(ConfigurationError):
        readers.unique(spark.createDataFrame([(1,), (1,)], "k int"), "k")
    made = {r.key: r["items"] for r in readers.synthetic_sets(spark, 50, 8, 7).collect()}
    assert len(made) == 50 and len({x for v in made.values() for x in v}) == 400
    reference, asked = readers.held_out(spark.range(10), F.col("id"), 3)
    assert {r.id for r in asked.collect()} == {7, 8, 9} and reference.count() == 7


def test_text_sinks_publish_all_or_nothing(spark, tmp_path):
    pairs = spark.createDataFrame([(1, 2, 0.5)], "a long, b long, similarity double")
    assert sinks.pair_text(pairs).first().value == "1\t2\t0.5000"
    assert json.loads(sinks.json_text(pairs).first().value) == {"a": 1, "b": 2, "similarity": 0.5}
    groups = spark.createDataFrame([(1, "1,2")], "representative long, members string")
    assert sinks.group_text(groups).first().value == "1\t1,2"
    found = spark.createDataFrame([(0, 4, 0.25), (0, 3, 0.75)], "query long, key long, similarity double")
    assert sinks.search_text(found).first().value == "0\t3:0.7500,4:0.2500"
    assert sinks.search_text(found.drop("similarity")).first().value == "0\t3,4"
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    sinks.publish(spark, {one: sinks.pair_text(pairs), two: sinks.group_text(groups)})
    assert spark.read.text(two).first().value == "1\t1,2"
    three = str(tmp_path / "three")
    with pytest.raises(StorageError):
        sinks.publish(spark, {three: sinks.pair_text(pairs), one: sinks.pair_text(pairs)})
    with pytest.raises(Exception):  # noqa: B017
        sinks.publish(spark, {three: sinks.pair_text(pairs), str(tmp_path / "four"): pairs.select(F.raise_error(F.lit("x")).cast("string").alias("value"))})
    assert not (tmp_path / "three").exists() and not (tmp_path / "four").exists()
