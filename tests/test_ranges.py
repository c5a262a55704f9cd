import random

import pytest
from pyspark.sql import functions as F

from kindred.errors import StorageError
from kindred.operators.dedupe import Settings
from kindred.streaming import index as index_module
from kindred.streaming import ranges
from kindred.streaming.groups import GroupedIndex
from kindred.streaming.index import StoredIndex

LAW = (4, 1, 32)


def settings():
    return Settings(num_perm=4, threshold=0.5)


def rows(spark, held):
    return spark.createDataFrame([(k, list(v)) for k, v in held.items()], "key long, signature array<long>")


def signed(spark, ids):
    return rows(spark, {i: (i, i, i, i) for i in ids})


def contents(index):
    return {r.key: tuple(r.signature) for r in index.live().collect()}


def files(path):
    return {f: f.stat().st_mtime_ns for f in path.glob("gen-*/range=*/part-*")}


def of_range(index, path, key):
    """Files of the range that holds a key."""
    pieces = index.meta["pieces"][index.meta["generations"][0]]
    return list((path / [folder for low, folder in pieces if low <= key][-1]).glob("part-*"))


def test_a_merge_writes_the_ranges_that_changed(spark, tmp_path):
    path = tmp_path / "index"
    index = StoredIndex.create(spark, str(path), settings()).insert_signatures(signed(spark, range(100)), LAW)
    index.compact(10)
    before = files(path)
    assert len(before) == len(index.meta["pieces"][index.meta["generations"][0]]) == 10
    index.insert_signatures(signed(spark, [-5, 1000]), LAW)
    index.remove(signed(spark, [42]), "key")
    # Ranges that nothing changes aren't even read: this one can't be.
    spoilt = of_range(index, path, 75)[0]
    spoilt.write_bytes(b"no parquet")
    (spoilt.parent / f".{spoilt.name}.crc").unlink()
    reader = StoredIndex.open(spark, str(path), read_only=True)
    assert index.merge(10) == 3 and len(index.meta["generations"]) == 1
    pieces = index.meta["pieces"][index.meta["generations"][0]]
    after = files(path)
    assert [low for low, _ in pieces] == sorted(low for low, _ in pieces) and pieces[0][0] == ranges.LOWEST
    assert all(after[f] == t for f, t in before.items() if f != spoilt) and len(after) == len(before) + 3
    assert {r.key for r in spark.read.parquet(*map(str, of_range(index, path, 1000))).collect()} == {*range(pieces[-1][0], 100), 1000}
    assert {r.file.split("/")[1]: r.problem for r in index.verify_files().collect()} == {spoilt.parent.name: "length"}
    assert reader.meta["generations"] != index.meta["generations"] and index.merge(10) == 0
    # Vacuum deletes the three replaced ranges, not the folder that holds the linked ones.
    index.vacuum()
    assert len(files(path)) == 10 and not set(files(path)) - set(after)


def test_ranges_are_cut_joined_and_vanish(spark, tmp_path):
    path = tmp_path / "index"
    index = StoredIndex.create(spark, str(path), settings()).insert_signatures(signed(spark, range(0, 1000, 10)), LAW)
    index.compact(10)
    index.insert_signatures(signed(spark, range(500, 600)[1:10]), LAW)
    index.insert_signatures(signed(spark, [i for i in range(511, 600) if i % 10]), LAW)
    index.merge(10)
    sizes = [spark.read.parquet(str(path / f)).count() for _, f in index.meta["pieces"][index.meta["generations"][0]]]
    assert sum(sizes) == len(index) == 190 and max(sizes) <= 20 and len(sizes) >= 17
    index.remove(signed(spark, range(0, 290)), "key")
    index.merge(10)
    kept = index.meta["pieces"][index.meta["generations"][0]]
    assert len(kept) < len(sizes) and kept[0][0] == ranges.LOWEST and len(index) == 161
    index.insert_signatures(signed(spark, [7]), LAW)
    assert index.merge(10) == 1 and 7 in contents(index)
    index.remove(index.live(), "key")
    index.merge(10)
    assert len(index) == 0 and index.meta["pieces"][index.meta["generations"][0]] == [] and {r.n for r in index.verify().collect()} == {0}
    index.insert_signatures(signed(spark, [1, 2]), LAW)
    assert index.merge(10) == 1 and set(contents(index)) == {1, 2}
    assert StoredIndex.create(spark, f"{tmp_path}/none", settings()).merge() == 0


@pytest.mark.parametrize("kind", [StoredIndex, GroupedIndex])
def test_random_changes_with_merges_equal_a_dictionary(spark, tmp_path, kind):
    rng = random.Random(11)
    path = tmp_path / "index"
    index, held, old = kind.create(spark, str(path), settings()), {}, None
    for step in range(4):
        fresh = [k for k in rng.sample(range(-60, 60), 25) if k not in held]
        new = {k: tuple(rng.randrange(5) for _ in range(4)) for k in fresh}
        index.insert_signatures(rows(spark, new), LAW)
        held |= new
        gone = rng.sample(sorted(held), 8)
        assert index.remove(signed(spark, gone), "key") == 8
        held = {k: v for k, v in held.items() if k not in gone}
        if step == 1:
            old = StoredIndex.open(spark, str(path), read_only=True), dict(held)
        if step % 2:
            index.merge(6)
        assert contents(index) == held
    assert contents(old[0]) == old[1]
    assert index.verify_files().count() == 0 and {r.n for r in index.verify().collect()} == {0}
    whole = StoredIndex.create(spark, f"{tmp_path}/whole", settings()).insert_signatures(rows(spark, held), LAW)
    found = [sorted(map(tuple, i.search_signatures(rows(spark, held), "key").collect())) for i in (index, whole)]
    assert found[0] == found[1]
    if kind is GroupedIndex:
        again = GroupedIndex.create(spark, f"{tmp_path}/again", settings()).insert_signatures(rows(spark, held), LAW)
        assert {tuple(r) for r in index.components().collect()} == {tuple(r) for r in again.components().collect()}
    index.vacuum()
    assert contents(StoredIndex.open(spark, str(path))) == held and index.verify_files().count() == 0


def test_a_merge_that_loses_the_race_leaves_nothing(spark, tmp_path, monkeypatch):
    path = tmp_path / "index"
    index = StoredIndex.create(spark, str(path), settings()).insert_signatures(signed(spark, range(30)), LAW)
    index.compact(10)
    index.insert_signatures(signed(spark, [31]), LAW)
    other = StoredIndex.open(spark, str(path))
    index.insert_signatures(signed(spark, [32]), LAW)
    there = sorted(p.name for p in path.iterdir())
    with pytest.raises(StorageError):
        other.merge(10)
    assert sorted(p.name for p in path.iterdir()) == there and set(contents(StoredIndex.open(spark, str(path)))) == {*range(30), 31, 32}
    # Commits beyond the most generations merge by themselves.
    monkeypatch.setattr(index_module, "MOST_GENERATIONS", 2)
    index.insert_signatures(signed(spark, [33]), LAW)
    assert len(index.meta["generations"]) == 1 and set(contents(index)) == {*range(30), 31, 32, 33}


def test_numbers_of_ranges(spark):
    keys = spark.createDataFrame([(-9,), (0,), (4,), (5,), (99,), (None,)], "key long")
    got = {r.key: r.at for r in keys.select("key", ranges.number(F.col("key"), [0, 5, 50]).alias("at")).collect()}
    assert got == {-9: 0, 0: 0, 4: 0, 5: 1, 99: 2, None: 0}
