import itertools
import random

import pytest
from pyspark.sql import functions as F

from kindred.errors import ClosedIndexError, CompatibilityError, ConfigurationError, DuplicateKeyError, ProgressCancelledError, StorageError
from kindred.functions import features as fx
from kindred.operators import dedupe, graph, lsh, minhash
from kindred.operators.dedupe import Deduplicator, Settings
from kindred.plans import planner
from kindred.streaming.index import StoredIndex


@pytest.fixture(scope="module")
def records(spark):
    rng = random.Random(3)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(40)]
        for _ in range(rng.randint(1, 4)):
            own = list(base)
            own[rng.randrange(40)] = "x"
            rows.append((len(rows), " ".join(own), len(rows) % 5))
    rows += [(len(rows), "", 0), (len(rows) + 1, "!", 1), (len(rows) + 2, None, 2)]
    return spark.createDataFrame(rows, "key long, text string, score int").cache()


def words():
    return fx.word_shingles(F.col("text"), 2)


def pairs(df):
    return {(r.a, r.b) for r in df.collect()}


def test_native_and_arrow_signatures_agree(spark, records):
    a = {r.key: r.signature for r in minhash.sign(records, "key", words(), 32, 7).collect()}
    b = {r.key: r.signature for r in minhash.sign_native(records, "key", words(), 32, 7).collect()}
    assert a == b and set(map(len, a.values())) == {32}
    empty = minhash.sign(records, "key", words(), 8, 7).where(minhash.is_empty(F.col("signature")))
    assert {r.key for r in empty.collect()} == {r.key for r in records.where("text is null or length(text) < 2").collect()}


def test_merging_is_the_signature_of_the_union(spark):
    rows = spark.createDataFrame([(1, 1, ["a", "b"]), (2, 1, ["c"]), (3, 2, []), (4, 2, ["d"])], "key long, g int, f array<string>")
    signed = minhash.sign(rows, "key", F.col("f"), 16, 5).join(rows, "key")
    whole = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["d"])], "g int, f array<string>")
    want = {r.g: r.signature for r in minhash.sign(whole, "g", F.col("f"), 16, 5).collect()}
    assert {r.g: r.signature for r in minhash.merge(signed, ["g"], 16).collect()} == want
    with pytest.raises(Exception, match="different lengths"):
        minhash.merge(signed, ["g"], 8).collect()


def test_candidates_match_shared_bands(spark, records):
    d = Deduplicator(records, "key", words(), Settings(num_perm=64))
    b, r = d.settings.bands
    sig = {x.key: x.signature for x in d.signed.collect()}
    want = {(x, y) for x, y in itertools.combinations(sorted(sig), 2) if any(sig[x][i * r : i * r + r] == sig[y][i * r : i * r + r] for i in range(b))}
    assert pairs(d.candidate_pairs()) == want
    scored = {(x.a, x.b): x.similarity for x in d.scored_pairs().collect()}
    assert scored == {(x, y): sum(i == j for i, j in zip(sig[x], sig[y], strict=True)) / 64 for x, y in want}


def union_find(edges, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_groups_are_components_of_accepted_pairs(spark, records):
    for more in ({}, {"min_similarity": 0.9}, {"exact": 0.9}, {"min_similarity": 0.85, "exact": 0.85}):
        d = Deduplicator(records, "key", words(), Settings(num_perm=64, threshold=0.7, **more))
        edges = {(r.a, r.b) for r in d.scored_pairs().collect() if r.similarity >= more.get("min_similarity", 0)}
        if "exact" in more:
            edges &= pairs(d.exact_pairs(more["exact"]))
        keys = [r.key for r in records.collect()]
        want = union_find(edges, keys)
        got = {r.key: (r.keep, r.representative) for r in d.decisions().collect()}
        assert got == {k: (k == c, c) for k, c in want.items()}
        sizes = {r.representative: r.size for r in d.groups(min_size=1).collect()}
        assert sum(sizes.values()) == len(keys) and d.kept().count() == len(sizes)


def test_components_of_random_graphs(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5000), (2, 1), (2, 1)]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == union_find(edges, {n for e in edges for n in e})


def test_representatives_and_singletons(spark):
    found = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "node long, component long")
    rows = spark.createDataFrame([(1, 5), (2, 9), (3, 9)], "key long, score int")
    assert graph.representatives(found, rows, "key", F.col("score")).first().representative == 2
    assert graph.with_singletons(found, spark.createDataFrame([(7,), (1,)], "key long"), "key").count() == 2


def test_distribution_is_nearest_rank(spark):
    sizes = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1), (100, 1)], "size long, n long")
    r = lsh.distribution(sizes).first()
    assert (r.buckets, r.memberships, r.p50, r.p95, r.p99, r.average) == (5, 110, 3, 100, 100, 22.0)
    values = spark.createDataFrame([(float(i),) for i in range(1, 101)], "v double")
    r = lsh.latency_percentiles(values, "v").first()
    assert (r.p50, r.p95, r.p99) == (51.0, 96.0, 100.0)


def test_scores_are_filtered_and_ordered(spark):
    rows = spark.createDataFrame([(0, 3, 0.5), (0, 1, 0.9), (0, 2, 0.9), (0, 4, 0.1)], "query long, key long, similarity double")
    assert [r.key for r in lsh.top(rows, 4).orderBy("rank").collect()] == [1, 2, 3, 4]
    assert [r.key for r in lsh.top(lsh.at_least(rows, 0.5), 2).orderBy("rank").collect()] == [1, 2]
    for bad in (-0.1, 1.1, float("nan")):
        with pytest.raises(ConfigurationError):
            lsh.at_least(rows, bad)
    with pytest.raises(ConfigurationError):
        lsh.top(rows, 0)


def test_exact_join_and_quality(spark, records):
    rows = records.where("text is not null")
    sets = {r.key: set(r.f) for r in rows.select("key", words().alias("f")).collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] & sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    found = dedupe.exact_join(rows, "key", words(), 0.8)
    assert pairs(found) == want
    r = lsh.quality(found, found.limit(1)).first()
    assert (r.recall, r.hits) == (1.0, 1) and r.precision == pytest.approx(1 / len(want))


def test_weighted_jaccard_and_simhash(spark):
    counts = spark.createDataFrame([(1, "a", 1), (2, "a", 7), (3, "a", 20), (3, "b", 1), (4, "a", 20)], "key long, token string, n long")
    asked = spark.createDataFrame([(1, 2), (3, 4), (8, 9)], "a long, b long")
    got = {(r.a, r.b): r.similarity for r in dedupe.weighted_jaccard(counts, asked).collect()}
    assert got[1, 2] == pytest.approx(1 / 7) and got[3, 4] == pytest.approx(20 / 21) and got[8, 9] == 1.0
    import hashlib

    h = {r.key: r.simhash & (2**64 - 1) for r in dedupe.simhash(counts).collect()}
    assert h[1] == h[2] == int.from_bytes(hashlib.sha256(b"a").digest()[:8], "little")


def test_audit(spark):
    reference = spark.createDataFrame([(1, "a b c d e f g h"), (2, "p q r s t u v w")], "key long, text string")
    asked = spark.createDataFrame([(10, "a b c d e f g h"), (11, "nothing like it at all here")], "item long, text string")
    got = {r["query"]: (r.candidate_count, r.matched, r.reference_matches) for r in dedupe.audit(reference, "key", asked, "item", words(), words(), exact=0.8).collect()}
    assert got == {10: (1, True, "1"), 11: (0, False, "")}
    r = dedupe.audit_summary(dedupe.audit(reference, "key", asked, "item", words(), words(), exact=0.8), 2).first()
    assert (r.queries, r.matched, r.overlap_rate, r.candidate_reduction) == (2, 1, 0.5, 0.75)


def test_tuning_and_plans():
    assert planner.tune(0.8, 128) == (9, 13)
    assert [planner.tune(t, 64) for t in (0.1, 0.2, 0.4, 0.5, 0.8, 0.9)] == [(15, 1), (28, 2), (16, 4), (14, 4), (5, 11), (3, 21)]
    p = planner.plan(1_000_000)
    sizes = [p[k] for k in ("signature_bytes_per_item", "index_metadata_bytes_per_item", "in_memory_index_bytes_per_item", "persistent_index_bytes", "lazy_resident_bytes_per_item")]
    assert sizes == [512, 152, 1072, 440_000_736, 512] and p["unused_permutations"] == 11
    assert planner.with_headroom(3) == 5
    for bad in (0.0, 1.1, float("nan")):
        with pytest.raises(ConfigurationError):
            planner.tune(bad, 64)
    with pytest.raises(ConfigurationError):
        planner.plan(0)
    with pytest.raises(ConfigurationError):
        planner.plan(5, params=(20, 20))


def test_stored_index_life(spark, records, tmp_path):
    path = str(tmp_path / "index")
    index = StoredIndex.create(spark, path, Settings(num_perm=32))
    with pytest.raises(StorageError):
        StoredIndex.create(spark, path)
    index.insert(records.where("key < 10"), "key", words())
    reader = StoredIndex.open(spark, path, read_only=True)
    with pytest.raises(DuplicateKeyError):
        index.insert(records.where("key between 9 and 12"), "key", words())
    assert len(index) == 10
    assert index.remove(spark.createDataFrame([(3,), (99,), (3,)], "k long"), "k") == 1
    index.insert(records.where("key in (3, 20)"), "key", words())
    assert len(index) == 11 and len(reader) == 10
    found = index.search(records.where("key = 20"), "key", words(), min_similarity=1.0, top_k=1).first()
    assert (found["query"], found.key, found.similarity) == (20, 20, 1.0)
    other = StoredIndex.open(spark, path)
    index.compact()
    with pytest.raises(StorageError):
        other.insert(records.where("key = 21"), "key", words())
    assert len(StoredIndex.open(spark, path).meta["generations"]) == 1 and {r.n for r in index.verify().collect()} == {0}
    with pytest.raises(StorageError):
        reader.insert(records.where("key = 22"), "key", words())
    with pytest.raises(CompatibilityError):
        index.insert_signatures(index.live(), (32, 2, 32))
    with index:
        pass
    with pytest.raises(ClosedIndexError):
        index.live()


def test_streams_add_each_key_once_and_can_be_stopped(spark, records, tmp_path):
    src = str(tmp_path / "in")
    records.repartition(2).write.parquet(src)
    stream = lambda: spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(src)
    index = StoredIndex.create(spark, str(tmp_path / "a"), Settings(num_perm=16))
    index.ingest(stream(), "key", words(), str(tmp_path / "ca")).awaitTermination()
    assert len(index) == records.count()
    index.ingest(stream(), "key", words(), str(tmp_path / "cb")).awaitTermination()
    assert len(index) == records.count()
    other = StoredIndex.create(spark, str(tmp_path / "b"), Settings(num_perm=16))
    seen = []
    q = other.ingest(stream(), "key", words(), str(tmp_path / "cc"), lambda n: seen.append(n) or False)
    with pytest.raises(Exception):  # noqa: B017
        q.awaitTermination()
    assert seen == [len(other)] and 0 < len(other) < records.count() and issubclass(ProgressCancelledError, Exception)
