"""Registered queries of the engine over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import features as fx
from .functions import hashing
from .operators import dedupe, graph, hamming, lsh, minhash
from .operators.dedupe import Deduplicator, Settings
from .operators.tables import shared_dir, shared_table
from .plans import planner
from .streaming import meetings
from .streaming.groups import GroupedIndex
from .streaming.index import StoredIndex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

SIMILARITY = 0.8


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


#: Bytes of a table's files that a task gets where it is dealt out, and of a file, on average, up to so many times which it is not.
PART_BYTES, WHOLE = 16 << 20, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one that lies in few files is dealt out, to all cores at least, for feature work is per row.  There are more parts where it
    is larger, so that a task's share doesn't grow with it.  Where files are small enough for a task each, nothing is exchanged."""
    df, parts = spark.read.parquet(f"{sf_dir}/{name}.parquet"), parts_of(spark, f"{sf_dir}/{name}.parquet")
    files = len(df.inputFiles())
    return df.repartition(parts) if files < max(spark.sparkContext.defaultParallelism, -(-parts // WHOLE)) else df


def parts_of(spark: SparkSession, path: str) -> int:
    """The number of parts that a table is dealt out in."""
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = held.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(held).getLength()
    return max(spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")


def words3():
    return fx.word_shingles(F.col("text"), 3)


def cut3() -> fx.WordShingles:
    """The same in the form that is quicker to sign."""
    return fx.WordShingles(F.col("text"), 3)


def documents_deduped(spark: SparkSession, sf_dir: str, **settings) -> Deduplicator:
    return Deduplicator(docs(spark, sf_dir), "doc_id", cut3(), Settings(**settings))


def _listed(values) -> tuple:
    """Number and digest of a list of strings in order."""
    return F.size(values).cast("bigint").alias("n"), F.md5(F.array_join(values, "\n")).alias("digest")


# --- features and hashes ---------------------------------------------------------------------------------------------


@query
def sha1_hash32_tokens(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", hashing.sha1_hash32(F.col("p_name")).alias("h32"), hashing.fmix32(hashing.sha1_hash32(F.col("p_name"))).alias("mixed"))


@query
def sha1_hash64_tokens(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", hashing.sha1_hash64(F.col("p_name")).cast("string").alias("h64"))


@query
def word_shingles(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *_listed(F.array_sort(words3())))


@query
def char_shingles(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *_listed(F.array_sort(fx.char_shingles(F.col("text"), 4))))


@query
def raw_word_shingles(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *_listed(F.array_sort(fx.word_shingles(F.col("text"), 2, normalize=False))))


@query
def text_shingles(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *_listed(fx.text_shingles(F.col("text"), 3)))


@query
def code_tokens(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", *_listed(fx.code_tokens(F.col("html"))))


@query
def code_shingles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", *_listed(fx.code_shingles(F.col("html"), 5)))


@query
def entity_features(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    own = fx.customer_features(F.col("c_name"), F.col("c_mktsegment"), F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")), F.format_string("+1 (%s)", F.col("c_custkey").cast("string")))
    return c.select("c_custkey", *_listed(own))


@query
def artifact_digests(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha256"))


# --- signatures ------------------------------------------------------------------------------------------------------


def _part_signed(spark, sf_dir, **more):
    return minhash.sign(table(spark, sf_dir, "part"), "p_partkey", fx.char_shingles(F.col("p_name"), 3), 16, 42, **more)


def _long(signed, key):
    return signed.select(key, F.posexplode("signature").alias("pos", "value"))


@query
def minhash_signature_long(spark, sf_dir):
    return _long(_part_signed(spark, sf_dir), "p_partkey")


@query
def minhash_signature_native(spark, sf_dir):
    return _long(minhash.sign_native(table(spark, sf_dir, "part"), "p_partkey", fx.char_shingles(F.col("p_name"), 3), 16, 42), "p_partkey")


@query
def minhash64_signature_long(spark, sf_dir):
    signed = _part_signed(spark, sf_dir, width=64)
    unsigned = F.col("value").cast("decimal(20,0)") + F.when(F.col("value") < 0, F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(0)
    return _long(signed, "p_partkey").select("p_partkey", "pos", unsigned.cast("string").alias("value"))


@query
def minhash_documents(spark, sf_dir):
    signed = minhash.sign(docs(spark, sf_dir), "doc_id", cut3())
    return signed.select("doc_id", F.md5(F.array_join("signature", ",")).alias("digest"))


@query
def minhash_merge_by_lang(spark, sf_dir):
    d = docs(spark, sf_dir)
    signed = minhash.sign(d, "doc_id", cut3()).join(d.select("doc_id", "lang"), "doc_id")
    return minhash.merge(signed, ["lang"], 128).select("lang", F.md5(F.array_join("signature", ",")).alias("digest"))


@query
def minhash64_merge_by_brand(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    merged = minhash.merge(_part_signed(spark, sf_dir, width=64).join(p, "p_partkey"), ["p_brand"], 16, 64)
    unsigned = F.col("value").cast("decimal(20,0)") + F.when(F.col("value") < 0, F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(0)
    return _long(merged, "p_brand").select("p_brand", "pos", unsigned.cast("string").alias("value"))


@query
def band_hashes_published(spark, sf_dir):
    """The buckets of the published band hash, for sharing with other programs."""
    s = Settings(num_perm=32)
    signed = minhash.sign(table(spark, sf_dir, "part"), "p_partkey", fx.char_shingles(F.col("p_name"), 3), 32, 1)
    return lsh.band_rows(signed, "p_partkey", *s.bands, published=True).select("key", "band", F.lower(F.lpad(F.hex("bucket"), 16, "0")).alias("bucket"))


def _next(p):
    """``a, b``: each part and the next one, if there is one."""
    own = p.select(F.col("p_partkey").alias("b"))
    return p.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b")).join(lsh.met_by_key(own), "b", "left_semi")


@query
def signature_similarity_pairs(spark, sf_dir):
    """The similarity of any two records: each part and the next one."""
    p = table(spark, sf_dir, "part")
    d = Deduplicator(p, "p_partkey", fx.char_shingles(F.col("p_name"), 3), Settings(num_perm=32))
    return d.similarity(_next(p))


@query
def hamming_similarity_pairs(spark, sf_dir):
    """The similarity of the 64-bit sketches of each user and the next one."""
    w = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key"), F.col("event_type").alias("token")).agg(F.count("*").alias("n"))
    own = dedupe.simhash(w)
    a, b = own.select(F.col("key").alias("a"), F.col("simhash").alias("x")), own.select(F.col("key").alias("b"), F.col("simhash").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", fx.hamming_similarity(F.col("x"), F.col("y")).alias("similarity"))


@query
def lsh_buckets(spark, sf_dir):
    d = documents_deduped(spark, sf_dir)
    return lsh.buckets(d.banded).groupBy("band", "size").agg(F.count("*").alias("buckets"))


@query
def bucket_distribution(spark, sf_dir):
    return lsh.bucket_distribution(documents_deduped(spark, sf_dir).banded)


# --- pairs and searches ----------------------------------------------------------------------------------------------


@query
def candidate_pairs(spark, sf_dir):
    return documents_deduped(spark, sf_dir).candidate_pairs()


@query
def candidate_pairs_scored(spark, sf_dir):
    return documents_deduped(spark, sf_dir).scored_pairs()


@query
def candidate_pairs_min_similarity(spark, sf_dir):
    return lsh.at_least(documents_deduped(spark, sf_dir).scored_pairs(), 0.9)


@query
def candidate_pairs_thresholds(spark, sf_dir):
    """The same signatures banded for several thresholds."""
    d, out = documents_deduped(spark, sf_dir), None
    for t in (0.5, 0.7, 0.9):
        pairs = lsh.candidate_pairs(lsh.band_rows(d.signed, "doc_id", *planner.tune(t, 128))).agg(F.count("*").alias("pairs")).select(F.lit(t).alias("threshold"), "pairs")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def _search(spark, sf_dir, threshold=0.3):
    s = Settings(threshold=threshold)
    d = minhash.sign(docs(spark, sf_dir), "doc_id", cut3())
    q = minhash.sign(table(spark, sf_dir, "benchmark"), "item_id", cut3())
    d, q = shared_table(d, "signatures"), shared_table(q, "signatures")
    return lsh.query(lsh.band_rows(d, "doc_id", *s.bands), lsh.band_rows(q, "item_id", *s.bands)), d, q


@query
def lsh_query(spark, sf_dir):
    return _search(spark, sf_dir)[0]


@query
def lsh_query_topk(spark, sf_dir):
    found, d, q = _search(spark, sf_dir)
    return lsh.top(lsh.at_least(lsh.score(found, "query", "key", q, "item_id", d, "doc_id"), 0.05), 3)


@query
def query_metrics(spark, sf_dir):
    found, d, q = _search(spark, sf_dir)
    return lsh.query_metrics(q.count(), found, d.count())


@query
def exact_jaccard_pairs(spark, sf_dir):
    return documents_deduped(spark, sf_dir).exact_pairs(SIMILARITY)


@query
def exact_join_bruteforce(spark, sf_dir):
    return dedupe.exact_join(table(spark, sf_dir, "conversations").select(F.expr("conv_id * 1000 + turn").alias("id"), "text"), "id", fx.word_shingles(F.col("text"), 3), 0.01)


@query
def recall_precision_vs_exact(spark, sf_dir):
    return documents_deduped(spark, sf_dir).exact_quality(SIMILARITY)


@query
def cross_source_quality(spark, sf_dir):
    """Documents with even ids against those with odd ones, at three thresholds; the truth is an exact similarity of one half."""
    return documents_deduped(spark, sf_dir).cross_quality(F.expr("doc_id % 2 = 0"), 0.5, [0.4, 0.6, 0.8])


@query
def candidate_rates(spark, sf_dir):
    """Observed against expected candidate rate of each part and the next one, by the similarity of their signatures."""
    p = table(spark, sf_dir, "part")
    d = Deduplicator(p, "p_partkey", fx.char_shingles(F.col("p_name"), 3), Settings(threshold=0.5, num_perm=16))
    pairs = d.similarity(_next(p))
    rates = lsh.candidate_rates(pairs, d.signed, "p_partkey", *d.settings.bands)
    return rates.select("similarity", "pairs", *[F.round(c, 9).alias(c) for c in ("observed", "expected", "absolute_error")])


# --- groups ----------------------------------------------------------------------------------------------------------


@query
def duplicate_groups(spark, sf_dir):
    return documents_deduped(spark, sf_dir).groups(verified=False)


@query
def duplicate_groups_verified(spark, sf_dir):
    return documents_deduped(spark, sf_dir, exact=SIMILARITY).groups()


@query
def duplicate_groups_min_similarity(spark, sf_dir):
    return documents_deduped(spark, sf_dir, min_similarity=0.9).groups()


@query
def duplicate_groups_min_size1(spark, sf_dir):
    return documents_deduped(spark, sf_dir).groups(min_size=1, verified=False)


@query
def group_pairs_external(spark, sf_dir):
    """Pairs that come from elsewhere: customers and their orders, whose keys are set apart."""
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), F.expr("1000000000 + o_orderkey").alias("b"))
    return graph.groups(graph.components(edges))


@query
def group_members(spark, sf_dir):
    """Groups of any size, a row for each member."""
    return graph.members(documents_deduped(spark, sf_dir).components(verified=False))


def _like_lengths(a, b):
    return (a["lang"] == b["lang"]) & (F.abs(a["n_chars"] - b["n_chars"]) <= 40)


@query
def duplicate_groups_predicate(spark, sf_dir):
    """Candidates are linked if a predicate on the two records holds: one language, and lengths that differ by 40 at most."""
    return Deduplicator(docs(spark, sf_dir), "doc_id", cut3(), Settings(), predicate=_like_lengths).groups()


@query
def representative_selected(spark, sf_dir):
    """A function chooses: the shortest document, the last of several."""
    d = documents_deduped(spark, sf_dir)
    shortest = lambda group: group.loc[group["n_chars"] == group["n_chars"].min(), "doc_id"].max()
    return graph.representatives(d.components(verified=False), d.records, "doc_id", shortest)


@query
def dedupe_result(spark, sf_dir):
    """The whole result: exact verification, the longest document of a group stays."""
    r = Deduplicator(docs(spark, sf_dir), "doc_id", cut3(), Settings(exact=SIMILARITY), representative=F.col("n_chars")).result()
    fate = r.kept.select("doc_id", F.lit("kept").alias("fate")).unionByName(r.dropped.select("doc_id", F.lit("dropped").alias("fate")))
    sizes = r.groups.select("doc_id", "size")
    return r.decisions.join(fate, "doc_id").join(sizes, "doc_id", "left").select("doc_id", "representative", "keep", "fate", F.coalesce("size", F.lit(1)).cast("bigint").alias("size"))


@query
def representative_longest(spark, sf_dir):
    d = documents_deduped(spark, sf_dir)
    return graph.representatives(d.components(verified=False), d.records, "doc_id", F.col("n_chars"))


@query
def dedupe_decisions(spark, sf_dir):
    return documents_deduped(spark, sf_dir).decisions(verified=False)


@query
def dedupe_summary(spark, sf_dir):
    return documents_deduped(spark, sf_dir).summary(verified=False)


@query
def conversation_dedupe(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.expr("conv_id * 1000 + turn").alias("id"), "text")
    return Deduplicator(c, "id", fx.char_shingles(F.col("text"), 5), Settings(threshold=0.7, num_perm=64, min_similarity=0.7)).decisions()


@query
def page_dedupe(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    return Deduplicator(p, "page_id", fx.code_shingles(F.col("html"), 5), Settings(num_perm=64, seed=7)).decisions(verified=False)


@query
def contamination_audit(spark, sf_dir):
    b, d = table(spark, sf_dir, "benchmark"), docs(spark, sf_dir)
    return dedupe.audit(d, "doc_id", b, "item_id", cut3(), cut3(), Settings(threshold=0.3), exact=0.1)


@query
def audit_summary(spark, sf_dir):
    return dedupe.audit_summary(contamination_audit(spark, sf_dir), docs(spark, sf_dir).count())


# --- entities, weights, sets -----------------------------------------------------------------------------------------


def _customers(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("label", F.expr("c_custkey % 500"))
    email = F.concat(F.lit("c"), F.col("label").cast("string"), F.lit("@example.com"))
    return c, fx.customer_features(F.lit(None).cast("string"), F.col("c_mktsegment"), email, F.col("label").cast("string"))


@query
def entity_customer_pairs(spark, sf_dir):
    c, own = _customers(spark, sf_dir)
    return Deduplicator(c, "c_custkey", own, Settings(threshold=0.4, seed=7)).candidate_pairs()


@query
def entity_product_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    own = fx.product_features(F.col("p_name"), F.col("p_brand"), F.lit(None).cast("string"), F.col("p_type"))
    return Deduplicator(p, "p_partkey", own, Settings(threshold=0.8, num_perm=64, seed=7)).candidate_pairs()


@query
def entity_quality(spark, sf_dir):
    c, own = _customers(spark, sf_dir)
    counts = Deduplicator(c, "c_custkey", own, Settings(threshold=0.4, seed=7)).candidate_counts(F.col("label"))
    zero = F.lit(0).cast("long")
    both = counts.select("candidates", "hits", zero.alias("pairs")).unionByName(lsh.pair_count(c, F.col("label")).select(zero.alias("candidates"), zero.alias("hits"), "pairs"))
    return both.agg(*[F.sum(n).alias(n) for n in ("candidates", "hits", "pairs")])


@query
def weighted_jaccard_tokens(spark, sf_dir):
    """Letters of the names of each part and the next one."""
    p = table(spark, sf_dir, "part")
    counts = p.select(F.col("p_partkey").alias("key"), F.explode(fx.char_shingles(F.col("p_name"), 1, normalize=True)).alias("token")).groupBy("key", "token").count()
    counts = counts.join(p.select(F.col("p_partkey").alias("key"), "p_name"), "key").select("key", "token", F.expr("length(p_name) - length(replace(lower(p_name), token, ''))").cast("bigint").alias("n"))
    return dedupe.weighted_jaccard(counts, _next(p))


@query
def simhash_tokens(spark, sf_dir):
    w = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key"), F.col("event_type").alias("token")).agg(F.count("*").alias("n"))
    return dedupe.simhash(w)


def _text_sketches(spark, sf_dir):
    """``key, code``: SimHash of each document's words; null where it has none.  A word that repeats votes each time, and the votes of a
    document are added up where its row lies, so that 64 sums leave a task for each."""
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("key"), "text")
    voted = dedupe.simhash(d.select("key", F.explode(fx.words(F.col("text"))).alias("token"), F.lit(1).alias("n")))
    return d.select("key").join(voted.withColumnRenamed("simhash", "code"), "key", "left")


@query
def hamming_links_3(spark, sf_dir):
    """Documents whose sketches differ in at most 3 of 64 bits."""
    return hamming.linked(shared_table(_text_sketches(spark, sf_dir), "sketches"), 3).withColumnRenamed("key", "doc_id")


@query
def hamming_links_7(spark, sf_dir):
    """Documents whose sketches differ in at most 7 of 64 bits."""
    return hamming.linked(shared_table(_text_sketches(spark, sf_dir), "sketches"), 7).withColumnRenamed("key", "doc_id")


@query
def integer_set_groups(spark, sf_dir):
    """Orders as sets of parts."""
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.expr("cast(l_partkey % 40 as string)"))).alias("items"))
    return Deduplicator(sets, "l_orderkey", F.col("items"), Settings(num_perm=64)).summary(verified=False)


# --- stored index ----------------------------------------------------------------------------------------------------


def _index(spark, sf_dir) -> tuple[StoredIndex, DataFrame]:
    import uuid

    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return StoredIndex.create(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", Settings(num_perm=32)), p


def _name3():
    return fx.char_shingles(F.col("p_name"), 3)


@query
def contains_many(spark, sf_dir):
    index, p = _index(spark, sf_dir)
    index.insert(p.where("p_partkey % 2 = 0"), "p_partkey", _name3())
    return index.contains(p, "p_partkey")


@query
def insert_reject_duplicates(spark, sf_dir):
    """A third of the parts; all others with one known key, which are refused as a whole; one more third."""
    from .errors import DuplicateKeyError

    index, p = _index(spark, sf_dir)
    index.insert(p.where("p_partkey % 3 = 0"), "p_partkey", _name3())
    try:
        index.insert(p.where("p_partkey % 3 <> 0 or p_partkey = 3"), "p_partkey", _name3())
    except DuplicateKeyError:
        index.insert(p.where("p_partkey % 3 = 2"), "p_partkey", _name3())
    return index.live_keys()


@query
def remove_keys(spark, sf_dir):
    index, p = _index(spark, sf_dir)
    index.insert(p, "p_partkey", _name3())
    index.remove(p.where("p_partkey % 7 = 3"), "p_partkey")
    return index.live_keys()


@query
def reinsert_generation(spark, sf_dir):
    """A key that was removed and added again has its new signature only."""
    index, p = _index(spark, sf_dir)
    index.insert(p, "p_partkey", _name3())
    index.remove(p.where("p_partkey % 5 = 0"), "p_partkey")
    index.insert(p.where("p_partkey % 10 = 0").withColumn("p_name", F.reverse("p_name")), "p_partkey", _name3())
    return index.live().select("key", F.element_at("signature", 1).alias("first"))


@query
def compacted_index(spark, sf_dir):
    index, p = _index(spark, sf_dir)
    index.insert(p, "p_partkey", _name3())
    index.remove(p.where("p_partkey % 11 = 0"), "p_partkey")
    index.compact()
    return index.history().select("key", "gen")


@query
def index_verify(spark, sf_dir):
    index, p = _index(spark, sf_dir)
    index.insert(p, "p_partkey", _name3())
    index.remove(p.where("p_partkey % 4 = 0"), "p_partkey")
    return index.verify()


@query
def index_search_topk(spark, sf_dir):
    index, p = _index(spark, sf_dir)
    index.insert(p, "p_partkey", _name3())
    return index.search(p.where("p_partkey % 50 = 0"), "p_partkey", _name3(), min_similarity=0.5, top_k=3)


@query
def index_without_signatures(spark, sf_dir):
    """An index of buckets alone finds candidates, but can't score them."""
    import uuid

    from .errors import ConfigurationError

    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    index = StoredIndex.create(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", Settings(num_perm=32, store_signatures=False))
    index.insert(p, "p_partkey", _name3())
    try:
        index.search(p, "p_partkey", _name3(), top_k=1)
    except ConfigurationError:
        return index.search(p.where("p_partkey % 50 = 0"), "p_partkey", _name3())
    raise AssertionError("scored without signatures")


@query
def streaming_incremental_dedupe(spark, sf_dir):
    """Documents arrive as a file stream, in three batches; the components of the final state are those of a batch."""
    import uuid

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    d = docs(spark, sf_dir).select("doc_id", "text")
    files = -(-parts_of(spark, f"{sf_dir}/documents.parquet") // 3)
    d.repartition(3 * files).write.parquet(f"{base}/in")
    index = StoredIndex.create(spark, f"{base}/index", Settings())
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in")
    index.ingest(stream, "doc_id", cut3(), f"{base}/checkpoint").awaitTermination()
    live = index.live()
    found = graph.components(lsh.anchor_pairs(lsh.band_rows(live, "key", *Settings().bands)))
    return graph.decisions(found, live, "key").withColumnRenamed("key", "doc_id")


@query
def streaming_bucket_sessions(spark, sf_dir):
    """Events stream in by time, in two runs of one checkpoint; those of a user and kind are one burst while six hours don't pass between them."""
    import uuid

    base = f"{shared_dir(spark)}/meet-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    half = e.agg(F.percentile_approx("ts", 0.5).alias("half"))
    marked = e.join(F.broadcast(half))
    kinds = F.array(F.concat(F.lit("user:"), F.col("user_id").cast("string")), F.concat(F.lit("type:"), "event_type"))
    for part in (marked.where("ts < half"), marked.where("ts >= half")):
        part.drop("half").write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(e.schema).parquet(f"{base}/in")
        found = meetings.links(stream, "event_id", "ts", kinds, 6 * 3600, "1 second", Settings(num_perm=32))
        meetings.start(found, f"{base}/links", f"{base}/checkpoint").awaitTermination()
    found = graph.components(meetings.read(spark, f"{base}/links"))
    return graph.decisions(found, e.withColumnRenamed("event_id", "key"), "key").withColumnRenamed("key", "event_id")


def _urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url")


def _url3():
    return fx.char_shingles(F.col("url"), 3)


@query
def index_bucket_lookup(spark, sf_dir):
    """Every hundredth page's address asks an index of several generations, in which buckets are looked up where they lie."""
    import uuid

    p = _urls(spark, sf_dir)
    index = StoredIndex.create(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", Settings(num_perm=32, store_signatures=False), lookups=True)
    index.insert(p.where("page_id % 3 <> 1"), "page_id", _url3())
    index.insert(p.where("page_id % 3 = 1"), "page_id", _url3())
    index.remove(p.where("page_id % 7 = 0"), "page_id")
    index.insert(p.where("page_id % 21 = 0"), "page_id", _url3())
    return index.search(p.where("page_id % 100 = 0"), "page_id", _url3())


@query
def incremental_groups(spark, sf_dir):
    """Groups of pages by address that stay current over insertions, removals and a new insertion of what was removed."""
    import uuid

    p = _urls(spark, sf_dir)
    index = GroupedIndex.create(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", Settings(num_perm=32))
    for i in range(2):
        index.insert(p.where(f"page_id % 2 = {i}"), "page_id", _url3())
    index.remove(p.where("page_id % 5 = 0"), "page_id")
    index.insert(p.where("page_id % 15 = 0"), "page_id", _url3())
    return index.decisions().withColumnRenamed("key", "page_id")


#: Keys of a range in ``merged_index``: signatures of 32 values are small, and each range is one task's.
_RANGE = 1 << 12


@query
def merged_index(spark, sf_dir):
    """Pages by address, the lower half of ids first: merges after the upper half came, some of it was removed and some of that came
    again with another address link the ranges of the lower half."""
    import uuid

    p = _urls(spark, sf_dir)
    upper = F.col("page_id") > (p.agg(F.max("page_id")).first()[0] or 0) // 2
    index = StoredIndex.create(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", Settings(num_perm=32))
    index.insert(p.where(~upper), "page_id", _url3())
    index.merge(_RANGE)
    index.insert(p.where(upper), "page_id", _url3())
    index.remove(p.where(upper & F.expr("page_id % 7 = 0")), "page_id")
    index.merge(_RANGE)
    index.insert(p.where(upper & F.expr("page_id % 21 = 0")).withColumn("url", F.reverse("url")), "page_id", _url3())
    index.merge(_RANGE)
    return index.live().select("key", F.element_at("signature", 1).alias("first"))


# --- plans and reports -----------------------------------------------------------------------------------------------


@query
def candidate_probability_curve(spark, sf_dir):
    s = spark.range(0, 21).select((F.col("id") / 20.0).cast("double").alias("similarity"))
    return s.select("similarity", F.round(hashing.candidate_probability(F.col("similarity"), 9, 13), 9).alias("probability"))


@query
def tune_params(spark, sf_dir):
    rows = [(t, p, *planner.tune(t, p)) for p in (64, 128) for t in (0.2, 0.4, 0.5, 0.8, 0.9)]
    return spark.createDataFrame(rows, "threshold double, num_perm int, bands int, rows int")


@query
def plan_report(spark, sf_dir):
    report = planner.plan_frame(spark, [planner.plan(n, 0.8, 128, b) for n, b in ((1_000_000, None), (1_000_000, 2 << 30), (10_000_000, 8 << 30), (10_000_000, 1 << 20))])
    reals = ["candidate_probability_at_threshold", "similarity_at_50_percent_candidates", "false_positive_area", "false_negative_area"]
    shown = {c: F.round(c, 9) for c in reals} | {"memory_budget_bytes": F.coalesce("memory_budget_bytes", F.lit(-1).cast("long"))}
    shown |= {c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in ("in_memory_fits_budget", "persistent_fits_budget")}
    return report.drop("recommendation_guidance").withColumns(shown)


@query
def storage_recommendation(spark, sf_dir):
    modes, budgets = ("auto", "memory", "persistent", "lazy", "redis"), (None, 1 << 40, 1 << 30, 1 << 20)
    rows = []
    for mode in modes:
        for budget in budgets:
            p = planner.plan(1_000_000, 0.8, 128, budget, mode)
            rows.append((mode, -1 if budget is None else budget, p["recommended_storage"], p["recommendation_reason"]))
    return spark.createDataFrame(rows, "mode string, budget long, storage string, reason string")


@query
def latency_percentiles(spark, sf_dir):
    return lsh.latency_percentiles(table(spark, sf_dir, "orders"), "o_totalprice")


@query
def report_comparison(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric"), (F.col("event_id") % 2).alias("side")).agg(F.count("*").cast("double").alias("value"))
    named = e.select("metric", F.lit("rows").alias("unit"), F.when(F.col("metric") < "m", "lower").otherwise("higher").alias("direction"), "value", "side")
    out = lsh.compare_reports(named.where("side = 0").drop("side"), named.where("side = 1").drop("side"))
    return out.withColumn("improvement_percent", F.round("improvement_percent", 9))
