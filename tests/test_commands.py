import json

import pytest

from kindred.__main__ import main

ROWS = [(1, ["a", "b", "c", "d"]), (2, ["a", "b", "c", "d"]), (3, ["x", "y"]), (4, ["a", "b", "c", "e"]), (5, [])]


@pytest.fixture
def data(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text("".join(json.dumps({"key": k, "values": v}) + "\n" for k, v in ROWS))
    (tmp_path / "q.jsonl").write_text('{"id":"one","values":["a","b","c","d"]}\n\n{"values":["nothing","like","it"]}\n')
    return tmp_path


def lines(capsys):
    return capsys.readouterr().out.splitlines()


@pytest.mark.parametrize("width", ["32", "64"])
def test_an_index_is_built_searched_and_kept(data, capsys, width):
    i = str(data / "index")
    assert main(["index", str(data / "in.jsonl"), i, "--num-perm", "64", "--threshold", "0.5", "--width", width, "--progress"]) == 0
    capsys.readouterr()
    assert main(["search", i, str(data / "q.jsonl"), "--min-similarity", "0.9"]) == 0
    found = sorted((json.loads(x) for x in lines(capsys)), key=lambda r: r["query"])
    assert [(r.get("id"), r["candidates"]) for r in found] == [("one", [1, 2]), (None, [])] and found[0]["scores"] == [1.0, 1.0]
    assert main(["search", i, str(data / "q.jsonl"), "--format", "tsv", "--top-k", "1"]) == 0
    assert sorted(lines(capsys))[0] == "0\tone\t1:1.0000"
    assert main(["verify", i]) == 0 and "wrong_buckets: 0" in lines(capsys)
    assert main(["compact", i]) == 0 and main(["stats", i, "--format", "json"]) == 0
    assert json.loads(lines(capsys)[-1])["keys"] == 5
    assert main(["explain", i]) == 0 and "parameter_source: existing" in lines(capsys)


def test_duplicates_are_listed(data, capsys):
    base = ["dedup", str(data / "in.jsonl"), "--num-perm", "64", "--min-similarity", "0.95"]
    assert main([*base, "--format", "tsv"]) == 0 and lines(capsys) == ["1\t1,2"]
    assert main([*base, "--pairs"]) == 0 and json.loads(lines(capsys)[0]) == {"a": 1, "b": 2, "similarity": 1.0}
    out = str(data / "groups")
    assert main([*base, "--min-size", "1", "--output", out]) == 0 and lines(capsys) == []
    assert main([*base, "--output", out]) == 2 and "exists" in capsys.readouterr().err


def test_plans_completion_and_errors(data, capsys):
    assert main(["plan", "--items", "1000", "--memory", str(1 << 30)]) == 0 and "recommended_storage: memory" in lines(capsys)
    assert main(["completion", "bash"]) == 0 and "dedup" in lines(capsys)[0]
    assert main(["completion", "zsh"]) == 0 and lines(capsys)[0] == "#compdef kindred"
    assert main(["plan", "--items", "0"]) == 2 and main(["stats", str(data / "none")]) == 2
    (data / "bad.jsonl").write_text('{"key":1,"values":["a"],"other":1}\n')
    with pytest.raises(Exception, match="line 1 of"):
        main(["index", str(data / "bad.jsonl"), str(data / "broken")])
    assert not (data / "broken").exists()
