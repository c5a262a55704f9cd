from pyspark.sql import functions as F

from kindred.operators.dedupe import Settings
from kindred.streaming.groups import GroupedIndex
from kindred.streaming.index import StoredIndex

LAW = (4, 1, 32)


def signed(spark, ids):
    return spark.createDataFrame([(i, [i, i, i, i]) for i in ids], "key long, signature array<long>")


def test_damaged_and_lost_files_are_named(spark, tmp_path):
    index = StoredIndex.create(spark, f"{tmp_path}/index", Settings(num_perm=4, threshold=0.5), lookups=True)
    index.insert_signatures(signed(spark, range(50)), LAW).insert_signatures(signed(spark, range(50, 80)), LAW)
    assert index.verify_files().count() == 0
    one, two = (sorted((tmp_path / "index" / g).glob("part-*")) for g in index.meta["generations"])
    look = next((tmp_path / "index" / f"look-{index.meta['generations'][1][4:]}").glob("part-*"))
    data = bytearray(one[0].read_bytes())
    data[len(data) // 2] ^= 1
    one[0].write_bytes(bytes(data))
    one[1].write_bytes(one[1].read_bytes()[:-3])
    two[0].unlink()
    look.write_bytes(look.read_bytes() + b"x")
    (two[1].parent / "part-other.parquet").write_bytes(two[1].read_bytes())
    for f in (tmp_path / "index").glob("*/.*.crc"):
        f.unlink()
    got = {r.file.split("/")[-1]: r.problem for r in StoredIndex.open(spark, f"{tmp_path}/index").verify_files().collect()}
    assert got == {one[0].name: "checksum", one[1].name: "length", two[0].name: "lost", look.name: "length", "part-other.parquet": "unknown"}


def test_files_of_a_compacted_and_vacuumed_index(spark, tmp_path):
    index = GroupedIndex.create(spark, f"{tmp_path}/index", Settings(num_perm=4, threshold=0.5))
    index.insert_signatures(signed(spark, range(20)), LAW)
    index.remove(signed(spark, [3]), "key")
    index.compact()
    index.vacuum()
    assert index.verify_files().count() == 0 and len(index.meta["manifests"]) == 1 and len(index) == 19
    assert {r.node for r in index.components().collect()} == set(range(20)) - {3}


def test_keys_follow_the_order_of_arrival_over_restarts(spark, tmp_path):
    for i in range(3):
        rows = [(f"text {i} {j}", j) for j in range(30)]
        spark.createDataFrame(rows, "text string, at long").repartition(3).write.parquet(f"{tmp_path}/in{i}")
    path = f"{tmp_path}/index"
    StoredIndex.create(spark, path, Settings(num_perm=4, threshold=0.5))
    features = F.split("text", " ")
    ranges = []
    for i in range(3):
        index = StoredIndex.open(spark, path)
        ranges.append(index.append(spark.read.parquet(f"{tmp_path}/in{i}"), features, [F.col("at")], ("feed", i)))
    assert ranges == [(0, 30), (30, 60), (60, 90)] and len(index) == 90
    # A key's signature is that of the record at its place.
    alone = StoredIndex.create(spark, f"{tmp_path}/alone", Settings(num_perm=4, threshold=0.5))
    alone.insert(spark.createDataFrame([(7, "text 1 12")], "id long, text string"), "id", features)
    assert index.signature(42) == alone.signature(7)
    # A replay is known from the log: nothing is read, nothing is added.
    again = StoredIndex.open(spark, path)
    again.live_keys = again.history = again._generation = None
    assert again.append(None, features, [F.col("at")], ("feed", 2)) == (90, 90)
    assert again.meta["version"] == index.meta["version"]


def test_a_stream_without_keys(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(f"t {i} {j}", j) for j in range(10)], "text string, at long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    index = StoredIndex.create(spark, f"{tmp_path}/index", Settings(num_perm=4, threshold=0.5))
    features = F.split("text", " ")

    def run(to):
        stream = spark.readStream.schema("text string, at long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        to.ingest(stream, None, features, f"{tmp_path}/checkpoint", order=[F.col("at")]).awaitTermination()

    run(index)
    assert sorted(r.key for r in index.live_keys().collect()) == list(range(30))
    assert index.meta["next_key"] == 30 and list(index.meta["batches"].values()) == [2]
    # The stream's own memory of the last batch is lost: the log still knows it.
    (tmp_path / "checkpoint/commits/2").unlink()
    for f in (tmp_path / "checkpoint/commits").glob(".2*"):
        f.unlink()
    run(StoredIndex.open(spark, f"{tmp_path}/index"))
    assert len(StoredIndex.open(spark, f"{tmp_path}/index")) == 30
