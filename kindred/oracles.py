"""DuckDB SQL that gives the rows of the registered queries."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# Fixed values, stated here once more so that nothing is shared with the engine: the parameters that each threshold and signature
# length are tuned to (bands, rows), the multipliers of the seed stream and of the finalisers, and of the band hash.
TUNED = {
    (0.3, 128): (37, 3), (0.4, 128): (32, 4), (0.5, 16): (5, 3), (0.5, 128): (25, 5), (0.6, 128): (18, 7), (0.7, 64): (8, 8), (0.7, 128): (14, 9),
    (0.8, 32): (3, 10), (0.8, 64): (5, 11), (0.8, 128): (9, 13), (0.9, 128): (5, 25),
}
STREAM = (11400714819323198485, 13787848793156543929, 10723151780598845931)
FMIX32 = (2246822507, 3266489909)
FMIX64 = (18397679294719823053, 14181476777654086739)
FNV = (14695981039346656037, 1099511628211)

# --- pieces ----------------------------------------------------------------------------------------------------------

FOLD = "replace(lower({t}), 'ß', 'ss')"
SEP = "chr(31)"


def words(t: str) -> str:
    return rf"regexp_extract_all({FOLD.format(t=t)}, '[\p{{L}}\p{{N}}_]+')"


def runs(w: str, k: int) -> str:
    joined = f" || {SEP} || ".join(f"{w}[i + {j}]" if j else f"{w}[i]" for j in range(k))
    return f"CASE WHEN len({w}) = 0 THEN [] WHEN len({w}) <= {k} THEN [array_to_string({w}, {SEP})] ELSE list_transform(range(1, len({w}) - {k} + 2), lambda i: {joined}) END"


def chars(t: str, k: int) -> str:
    return f"CASE WHEN length({t}) = 0 THEN [] WHEN length({t}) <= {k} THEN [{t}] ELSE list_distinct(list_transform(range(1, length({t}) - {k} + 2), lambda i: substring({t}, i, {k}))) END"


def folded(t: str) -> str:
    return rf"trim(regexp_replace({FOLD.format(t=t)}, '\s+', ' ', 'g'))"


def listed(values: str) -> str:
    return f"CAST(len({values}) AS BIGINT) AS n, md5(array_to_string({values}, chr(10))) AS digest"


def le(hex_: str, n: int) -> str:
    return "('0x' || " + " || ".join(f"substr({hex_}, {2 * i + 1}, 2)" for i in reversed(range(n))) + ")::UBIGINT"


def features(source: str, key: str, expr: str, where: str = "") -> str:
    """CTE ``f(key, feature)``."""
    return f"f AS (SELECT DISTINCT key, unnest(fs) AS feature FROM (SELECT {key} AS key, {expr} AS fs FROM {source} {where}))"


_T64 = "18446744073709551616"


def mul64(h: str, factor: str) -> str:
    """h * factor modulo 2**64 in 128 bits: the upper half of h is reduced first."""
    return f"((((({h} >> 32)::UHUGEINT * {factor}) % 4294967296::UHUGEINT) * 4294967296::UHUGEINT + ({h} & 4294967295)::UHUGEINT * {factor}) % {_T64}::UHUGEINT)::UBIGINT"


def permutations(num_perm: int, seed: int, width: int = 32) -> str:
    """CTE ``perm(pos, a, b)``: the seed stream, of which the first half are multipliers (made odd) and the rest offsets."""
    low = "& 4294967295::UBIGINT" if width == 32 else ""
    return f"""
        z0 AS (SELECT i, (({seed}::UHUGEINT + (i + 1)::UHUGEINT * '{STREAM[0]}'::UHUGEINT) % {_T64}::UHUGEINT)::UBIGINT AS z FROM range({2 * num_perm}) t(i)),
        z1 AS (SELECT i, {mul64('xor(z, z >> 30)', f"'{STREAM[1]}'::UHUGEINT")} AS z FROM z0),
        z2 AS (SELECT i, {mul64('xor(z, z >> 27)', f"'{STREAM[2]}'::UHUGEINT")} AS z FROM z1),
        z3 AS (SELECT i, xor(z, z >> 31) {low} AS z FROM z2),
        perm AS (SELECT CAST(x.i AS INTEGER) AS pos, x.z | 1::UBIGINT AS a, y.z AS b FROM z3 x JOIN z3 y ON y.i = x.i + {num_perm} WHERE x.i < {num_perm})"""


def signed(source: str, key: str, expr: str, num_perm: int = 128, seed: int = 1, where: str = "", words_from: str | None = None) -> str:
    """CTEs up to ``s(key, pos, value)`` and ``sig(key, signature)``, empty sets having all ones."""
    m1, m2 = FMIX32
    src = source if words_from is None else f"(SELECT *, {words(words_from)} AS w FROM {source} {where})"
    return f"""
        {features(src, key, expr, where if words_from is None else '')},
        h0 AS (SELECT key, {le('sha1(feature)', 4)} AS h FROM f),
        h1 AS (SELECT key, (xor(h, h >> 16) * {m1}) % 4294967296 AS h FROM h0),
        h2 AS (SELECT key, (xor(h, h >> 13) * {m2}) % 4294967296 AS h FROM h1),
        h3 AS (SELECT key, xor(h, h >> 16) AS h FROM h2),
        {permutations(num_perm, seed)},
        m AS (SELECT key, pos, min((a * h + b) % 4294967296) AS value FROM h3, perm GROUP BY ALL),
        k AS (SELECT {key} AS key FROM {source} {where}),
        s AS (SELECT k.key, perm.pos, coalesce(CAST(m.value AS BIGINT), 4294967295) AS value FROM k CROSS JOIN perm LEFT JOIN m ON m.key = k.key AND m.pos = perm.pos),
        sig AS (SELECT key, list(value ORDER BY pos) AS signature FROM s GROUP BY key)"""


def banded(threshold: float, num_perm: int, sig: str = "sig", name: str = "bd") -> str:
    bands, rows = TUNED[threshold, num_perm]
    return f"""
        {name} AS (SELECT key, b.band, signature[b.band * {rows} + 1 : b.band * {rows} + {rows}] AS bucket
               FROM {sig}, (SELECT unnest(range({bands})) AS band) b)"""


PAIRS = """
        c AS (SELECT DISTINCT x.key AS a, y.key AS b FROM bd x JOIN bd y ON x.band = y.band AND x.bucket = y.bucket AND x.key < y.key)"""

SIMILAR = """
        sc AS (SELECT c.a, c.b, CAST(len(list_filter(range(1, len(x.signature) + 1), lambda i: x.signature[i] = y.signature[i])) AS DOUBLE)
               / len(x.signature) AS similarity FROM c JOIN sig x ON x.key = c.a JOIN sig y ON y.key = c.b)"""

FSIZE = "fn AS (SELECT key, count(*) AS n FROM f GROUP BY key)"

EXACT = f"""
        {FSIZE},
        ov AS (SELECT c.a, c.b, count(g.feature) AS n FROM c JOIN f ON f.key = c.a LEFT JOIN f g ON g.key = c.b AND g.feature = f.feature GROUP BY ALL),
        ex AS (SELECT ov.a, ov.b, CAST(ov.n AS DOUBLE) / (x.n + y.n - ov.n) AS jaccard FROM ov JOIN fn x ON x.key = ov.a JOIN fn y ON y.key = ov.b)"""


def truth(least: float) -> str:
    return f"""
        t AS (SELECT x.key AS a, y.key AS b, CAST(count(*) AS DOUBLE) / (any_value(nx.n) + any_value(ny.n) - count(*)) AS jaccard
              FROM f x JOIN f y ON x.feature = y.feature AND x.key < y.key JOIN fn nx ON nx.key = x.key JOIN fn ny ON ny.key = y.key
              GROUP BY ALL HAVING jaccard >= {least})"""


def components(edges: str, nodes: str) -> str:
    """CTE ``cc(node, component)`` over ``nodes(node)``."""
    return f"""
        ed AS (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}),
        cc(node, component) USING KEY (node) AS (
            SELECT node, node FROM {nodes}
            UNION SELECT e.b, min(p.component) FROM cc AS p JOIN ed e ON e.a = p.node JOIN recurring.cc AS o ON o.node = e.b
            WHERE p.component < o.component GROUP BY e.b)"""


DOC3 = runs("w", 3)
DOCS = signed("documents", "doc_id", DOC3, words_from="text")
DOC_PAIRS = f"{DOCS}, {banded(0.8, 128)}, {PAIRS}"
NODES = "nd AS (SELECT doc_id AS node FROM documents)"
GROUPED = "SELECT component AS representative, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS members, count(*) AS size FROM cc GROUP BY component"
DECIDED = "SELECT node AS {key}, node = component AS keep, component AS representative FROM cc"


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


# --- features and hashes ---------------------------------------------------------------------------------------------

_m1, _m2 = FMIX32
oracle("sha1_hash32_tokens", f"""
    WITH a AS (SELECT p_partkey, {le('sha1(p_name)', 4)} AS h FROM part),
    b AS (SELECT *, (xor(h, h >> 16) * {_m1}) % 4294967296 AS x FROM a),
    c AS (SELECT *, (xor(x, x >> 13) * {_m2}) % 4294967296 AS y FROM b)
    SELECT p_partkey, CAST(h AS BIGINT) AS h32, CAST(xor(y, y >> 16) AS BIGINT) AS mixed FROM c""")
oracle("sha1_hash64_tokens", f"SELECT p_partkey, CAST({le('sha1(p_name)', 8)} AS VARCHAR) AS h64 FROM part")
oracle("word_shingles", f"WITH a AS (SELECT doc_id, {words('text')} AS w FROM documents), b AS (SELECT doc_id, list_sort(list_distinct({DOC3})) AS v FROM a) SELECT doc_id, {listed('v')} FROM b")
oracle("char_shingles", f"WITH a AS (SELECT conv_id, turn, {folded('text')} AS t FROM conversations), b AS (SELECT conv_id, turn, list_sort({chars('t', 4)}) AS v FROM a) SELECT conv_id, turn, {listed('v')} FROM b")
oracle("raw_word_shingles", rf"WITH a AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents), b AS (SELECT doc_id, list_sort(list_distinct({runs('w', 2)})) AS v FROM a) SELECT doc_id, {listed('v')} FROM b")
oracle("text_shingles", f"WITH a AS (SELECT doc_id, {words('text')} AS w FROM documents), b AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [''] ELSE {DOC3} END AS v FROM a) SELECT doc_id, {listed('v')} FROM b")
oracle("artifact_digests", "SELECT doc_id, sha256(text) AS sha256 FROM documents")

# The published lexer's numbers, strings and operators, in DuckDB's spelling.
_DIGITS = "[0-9](?:_?[0-9])*"
_NUMBER = rf"0[xX][0-9A-Fa-f](?:_?[0-9A-Fa-f])*|0[bB][01](?:_?[01])*|(?:{_DIGITS})?(?:\.{_DIGITS})+(?:[eE][+-]?{_DIGITS})?|{_DIGITS}(?:[eE][+-]?{_DIGITS})?"
_STRING = r"""''(?:\\.|[^''\\])*''|"(?:\\.|[^"\\])*\""""
_TOKEN = rf"[\p{{L}}_][\p{{L}}\p{{N}}_]*|{_NUMBER}|{_STRING}|===|!==|>>>|<<=|>>=|==|!=|<=|>=|=>|->|::|&&|\|\||\+\+|--|\*\*|<<|>>|:=|\S"
_CODE = rf"""
    t AS (SELECT page_id, regexp_extract_all(replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '{_TOKEN}') AS w0 FROM pages),
    w AS (SELECT page_id, list_transform(w0, lambda x: CASE WHEN regexp_full_match(x, '{_NUMBER}') THEN '<number>' WHEN regexp_full_match(x, '(?s){_STRING}') THEN '<string>' ELSE x END) AS w FROM t)"""
oracle("code_tokens", f"WITH {_CODE} SELECT page_id, {listed('w')} FROM w")
oracle("code_shingles", f"WITH {_CODE}, v AS (SELECT page_id, {runs('w', 5)} AS v FROM w) SELECT page_id, {listed('v')} FROM v")

_name_words = words("c_name")
oracle("entity_features", rf"""
    WITH a AS (SELECT c_custkey, {_name_words} AS nw, {words('c_mktsegment')} AS aw, {FOLD.format(t="trim(lower(replace(c_name, '#', '.')) || '@example.com')")} AS mail,
         '^' || array_to_string({_name_words}, ' ') || '$' AS pad, '1' || CAST(c_custkey AS VARCHAR) AS digits FROM customer),
    b AS (SELECT c_custkey, list_sort(list_distinct(list_concat(list_transform(nw, lambda x: 'name:word:' || x), list_transform({chars('pad', 3)}, lambda x: 'name:gram:' || x),
         list_transform(aw, lambda x: 'address:word:' || x), ['email:exact:' || mail, 'email:domain:example.com', 'phone:exact:' || right(digits, 10)]))) AS v FROM a)
    SELECT c_custkey, {listed('v')} FROM b""")

# --- signatures ------------------------------------------------------------------------------------------------------

_PART = signed("(SELECT p_partkey, " + folded("p_name") + " AS t FROM part)", "p_partkey", chars("t", 3), 16, 42)
oracle("minhash_signature_long", f"WITH {_PART} SELECT key AS p_partkey, pos, value FROM s")
oracle("minhash_signature_native", ORACLES["minhash_signature_long"])
_WIDE = f""" {features("(SELECT p_partkey, " + folded("p_name") + " AS t FROM part)", "p_partkey", chars("t", 3))},
    h0 AS (SELECT key, {le('sha1(feature)', 8)} AS h FROM f),
    h1 AS (SELECT key, xor(h, h >> 33) AS h FROM h0),
    h2 AS (SELECT key, {mul64('h', f"'{FMIX64[0]}'::UHUGEINT")} AS h FROM h1),
    h3 AS (SELECT key, xor(h, h >> 33) AS h FROM h2),
    h4 AS (SELECT key, {mul64('h', f"'{FMIX64[1]}'::UHUGEINT")} AS h FROM h3),
    h5 AS (SELECT key, xor(h, h >> 33) AS h FROM h4),
    {permutations(16, 42, 64)},
    m AS (SELECT key, pos, min((({mul64('h', 'a::UHUGEINT')}::UHUGEINT + b::UHUGEINT) % {_T64}::UHUGEINT)::UBIGINT) AS value FROM h5, perm GROUP BY ALL)
    """
oracle("minhash64_signature_long", f"WITH {_WIDE} SELECT key AS p_partkey, pos, CAST(value AS VARCHAR) AS value FROM m")
oracle("minhash64_merge_by_brand", f"WITH {_WIDE} SELECT p_brand, pos, CAST(min(value) AS VARCHAR) AS value FROM m JOIN part ON p_partkey = key GROUP BY p_brand, pos")
oracle("minhash_documents", f"WITH {DOCS} SELECT key AS doc_id, md5(array_to_string(signature, ',')) AS digest FROM sig")
oracle("minhash_merge_by_lang", f"WITH {DOCS}, g AS (SELECT lang, pos, min(value) AS value FROM s JOIN documents ON doc_id = key GROUP BY ALL) SELECT lang, md5(string_agg(CAST(value AS VARCHAR), ',' ORDER BY pos)) AS digest FROM g GROUP BY lang")
_SIZES = "z AS (SELECT band, bucket, count(*) AS size FROM bd GROUP BY ALL)"
oracle("lsh_buckets", f"WITH {DOCS}, {banded(0.8, 128)}, {_SIZES} SELECT CAST(band AS INTEGER) AS band, size, count(*) AS buckets FROM z GROUP BY ALL")
oracle("bucket_distribution", f"""WITH {DOCS}, {banded(0.8, 128)}, {_SIZES} SELECT count(*) AS buckets, CAST(sum(size) AS BIGINT) AS memberships, min(size) AS min,
    quantile_disc(size, 0.5) AS p50, quantile_disc(size, 0.95) AS p95, quantile_disc(size, 0.99) AS p99, max(size) AS max, CAST(sum(size) AS DOUBLE) / count(*) AS average FROM z""")

# --- pairs and searches ----------------------------------------------------------------------------------------------

oracle("candidate_pairs", f"WITH {DOC_PAIRS} SELECT a, b FROM c")
oracle("candidate_pairs_scored", f"WITH {DOC_PAIRS}, {SIMILAR} SELECT a, b, similarity FROM sc")
oracle("candidate_pairs_min_similarity", f"WITH {DOC_PAIRS}, {SIMILAR} SELECT a, b, similarity FROM sc WHERE similarity >= 0.9")
oracle("candidate_pairs_thresholds", f"WITH {DOCS}, " + ", ".join(banded(t, 128, name=f"b{i}") for i, t in enumerate((0.5, 0.7, 0.9))) + " " + " UNION ALL ".join(
    f"SELECT CAST({t} AS DOUBLE) AS threshold, count(*) AS pairs FROM (SELECT DISTINCT x.key, y.key FROM b{i} x JOIN b{i} y ON x.band = y.band AND x.bucket = y.bucket AND x.key < y.key)" for i, t in enumerate((0.5, 0.7, 0.9))))


def _both(threshold: float) -> str:
    """Documents and benchmark items in one set of CTEs; items have the keys from a million on."""
    source = "(SELECT doc_id AS key0, text FROM documents UNION ALL SELECT item_id + 1000000000, text FROM benchmark)"
    return f"""{signed(source, 'key0', DOC3, words_from='text')}, {banded(threshold, 128)},
        c AS (SELECT DISTINCT x.key AS a, y.key AS b FROM bd x JOIN bd y ON x.band = y.band AND x.bucket = y.bucket AND x.key >= 1000000000 AND y.key < 1000000000)"""


oracle("lsh_query", f"WITH {_both(0.3)} SELECT a - 1000000000 AS query, b AS key FROM c")
oracle("lsh_query_topk", f"""WITH {_both(0.3)}, {SIMILAR}, r AS (SELECT a - 1000000000 AS query, b AS key, similarity, CAST(row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS INTEGER) AS rank
    FROM sc WHERE similarity >= 0.05) SELECT * FROM r WHERE rank <= 3""")
oracle("query_metrics", f"""WITH {_both(0.3)}, n AS (SELECT (SELECT count(*) FROM benchmark) AS q, (SELECT count(*) FROM documents) AS d, (SELECT count(*) FROM c) AS c)
    SELECT q AS queries, c AS candidates, q * d AS possible, CAST(c AS DOUBLE) / (q * d) AS candidate_rate FROM n""")
oracle("exact_jaccard_pairs", f"WITH {DOC_PAIRS}, {EXACT} SELECT a, b, jaccard FROM ex WHERE jaccard >= 0.8")
_CONV = "(SELECT conv_id * 1000 + turn AS id, text FROM conversations)"
_CONVF = features(f"(SELECT id, {words('text')} AS w FROM {_CONV})", "id", DOC3)
oracle("exact_join_bruteforce", f"WITH {_CONVF}, {FSIZE}, {truth(0.01)} SELECT a, b, jaccard FROM t")
oracle("recall_precision_vs_exact", f"""WITH {DOC_PAIRS}, {FSIZE}, {truth(0.8)}, n AS (SELECT (SELECT count(*) FROM c) AS candidates, (SELECT count(*) FROM t) AS matches, (SELECT count(*) FROM c JOIN t USING (a, b)) AS hits)
    SELECT *, CAST(hits AS DOUBLE) / matches AS recall, CAST(hits AS DOUBLE) / candidates AS precision FROM n""")

_NEXT = "q AS (SELECT x.p_partkey AS a, y.p_partkey AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1)"
_EQUAL = "CAST(len(list_filter(range(1, len(x.signature) + 1), lambda i: x.signature[i] = y.signature[i])) AS DOUBLE) / len(x.signature)"
_PART32 = signed("(SELECT p_partkey, " + folded("p_name") + " AS t FROM part)", "p_partkey", chars("t", 3), 32, 1)
oracle("signature_similarity_pairs", f"WITH {_PART32}, {_NEXT} SELECT a, b, {_EQUAL} AS similarity FROM q JOIN sig x ON x.key = a JOIN sig y ON y.key = b")
_PART16 = signed("(SELECT p_partkey, " + folded("p_name") + " AS t FROM part)", "p_partkey", chars("t", 3), 16, 1)
oracle("candidate_rates", f"""WITH {_PART16}, {_NEXT}, e AS (SELECT {_EQUAL} AS similarity,
    list_contains(list_transform(range(5), lambda i: x.signature[i * 3 + 1 : i * 3 + 3] = y.signature[i * 3 + 1 : i * 3 + 3]), true) AS met FROM q JOIN sig x ON x.key = a JOIN sig y ON y.key = b),
    g AS (SELECT similarity, count(*) AS pairs, avg(CAST(met AS DOUBLE)) AS observed, 1 - pow(1 - pow(similarity, 3), 5) AS expected FROM e GROUP BY similarity)
    SELECT similarity, pairs, round(observed, 9) AS observed, round(expected, 9) AS expected, round(abs(observed - expected), 9) AS absolute_error FROM g""")
_HALVES = " UNION ALL ".join(f"""
    SELECT CAST({t} AS DOUBLE) AS threshold, (SELECT count(*) FROM tr) AS true_pairs, count(*) AS candidate_pairs, count(tr.a) AS true_candidates
    FROM (SELECT DISTINCT x.key AS a, y.key AS b FROM hv{i} x JOIN hv{i} y ON x.band = y.band AND x.bucket = y.bucket AND x.key % 2 = 0 AND y.key % 2 = 1) p LEFT JOIN tr USING (a, b)""" for i, t in enumerate((0.4, 0.6, 0.8)))
oracle("cross_source_quality", f"""WITH {DOCS}, {", ".join(banded(t, 128, name=f"hv{i}") for i, t in enumerate((0.4, 0.6, 0.8)))}, {FSIZE}, {truth(0.5)},
    tr AS (SELECT CASE WHEN a % 2 = 0 THEN a ELSE b END AS a, CASE WHEN a % 2 = 0 THEN b ELSE a END AS b FROM t WHERE a % 2 <> b % 2),
    n AS (SELECT count(*) FILTER (WHERE doc_id % 2 = 0) * count(*) FILTER (WHERE doc_id % 2 = 1) AS possible FROM documents), q AS ({_HALVES})
    SELECT q.*, CAST(true_candidates AS DOUBLE) / nullif(true_pairs, 0) AS candidate_recall, CAST(true_candidates AS DOUBLE) / nullif(candidate_pairs, 0) AS candidate_precision,
           1 - CAST(candidate_pairs AS DOUBLE) / possible AS candidate_reduction_ratio FROM q, n""")

# --- groups ----------------------------------------------------------------------------------------------------------

oracle("duplicate_groups", f"WITH RECURSIVE {DOC_PAIRS}, {NODES}, {components('c', 'nd')} {GROUPED} HAVING count(*) > 1")
oracle("duplicate_groups_verified", f"WITH RECURSIVE {DOC_PAIRS}, {EXACT}, {NODES}, ok AS (SELECT a, b FROM ex WHERE jaccard >= 0.8), {components('ok', 'nd')} {GROUPED} HAVING count(*) > 1")
oracle("duplicate_groups_min_similarity", f"WITH RECURSIVE {DOC_PAIRS}, {SIMILAR}, {NODES}, ok AS (SELECT a, b FROM sc WHERE similarity >= 0.9), {components('ok', 'nd')} {GROUPED} HAVING count(*) > 1")
oracle("duplicate_groups_min_size1", f"WITH RECURSIVE {DOC_PAIRS}, {NODES}, {components('c', 'nd')} {GROUPED}")
oracle("group_pairs_external", f"""WITH RECURSIVE e AS (SELECT o_custkey AS a, 1000000000 + o_orderkey AS b FROM orders),
    nd AS (SELECT a AS node FROM e UNION SELECT b FROM e), {components('e', 'nd')} {GROUPED} HAVING count(*) > 1""")
oracle("group_members", f"""WITH RECURSIVE {DOC_PAIRS}, {NODES}, {components('c', 'nd')}, z AS (SELECT component, node, count(*) OVER (PARTITION BY component) AS size FROM cc)
    SELECT * FROM z WHERE size > 1""")
oracle("duplicate_groups_predicate", f"""WITH RECURSIVE {DOC_PAIRS}, {NODES}, ok AS (SELECT a, b FROM c JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b
    WHERE x.lang = y.lang AND abs(x.n_chars - y.n_chars) <= 40), {components('ok', 'nd')} {GROUPED} HAVING count(*) > 1""")
_CHOSEN = """r AS (SELECT component, node, n_chars, count(*) OVER (PARTITION BY component) AS size,
    row_number() OVER (PARTITION BY component ORDER BY {order}) AS n FROM cc JOIN documents ON doc_id = node)"""
oracle("representative_selected", f"""WITH RECURSIVE {DOC_PAIRS}, {NODES}, {components('c', 'nd')}, {_CHOSEN.format(order='n_chars, node DESC')}
    SELECT component, node AS representative FROM r WHERE n = 1 AND size > 1""")
oracle("dedupe_result", f"""WITH RECURSIVE {DOC_PAIRS}, {EXACT}, {NODES}, ok AS (SELECT a, b FROM ex WHERE jaccard >= 0.8), {components('ok', 'nd')}, {_CHOSEN.format(order='n_chars DESC, node')}
    SELECT x.node AS doc_id, y.node AS representative, x.node = y.node AS keep, CASE WHEN x.node = y.node THEN 'kept' ELSE 'dropped' END AS fate, x.size FROM r x JOIN r y ON x.component = y.component AND y.n = 1""")
oracle("representative_longest", f"""WITH RECURSIVE {DOC_PAIRS}, {NODES}, {components('c', 'nd')}, r AS (SELECT component, node, n_chars, count(*) OVER (PARTITION BY component) AS size,
    row_number() OVER (PARTITION BY component ORDER BY n_chars DESC, node) AS n FROM cc JOIN documents ON doc_id = node) SELECT component, node AS representative FROM r WHERE n = 1 AND size > 1""")
oracle("dedupe_decisions", f"WITH RECURSIVE {DOC_PAIRS}, {NODES}, {components('c', 'nd')} {DECIDED.format(key='doc_id')}")
oracle("streaming_incremental_dedupe", ORACLES["dedupe_decisions"])
_SUMMARY = """SELECT CAST(sum(n) AS BIGINT) AS records, count(*) FILTER (WHERE n > 1) AS groups, CAST(sum(n - 1) AS BIGINT) AS duplicates,
    CAST(sum(n - 1) AS DOUBLE) / sum(n) AS duplicate_rate FROM (SELECT component, count(*) AS n FROM cc GROUP BY 1)"""
oracle("dedupe_summary", f"WITH RECURSIVE {DOC_PAIRS}, {NODES}, {components('c', 'nd')} {_SUMMARY}")
_CONVC = signed(f"(SELECT id, {folded('text')} AS t FROM {_CONV})", "id", chars("t", 5), 64, 1)
oracle("conversation_dedupe", f"WITH RECURSIVE {_CONVC}, {banded(0.7, 64)}, {PAIRS}, {SIMILAR}, nd AS (SELECT id AS node FROM {_CONV}), ok AS (SELECT a, b FROM sc WHERE similarity >= 0.7), {components('ok', 'nd')} {DECIDED.format(key='id')}")
_PAGE = f"WITH RECURSIVE {_CODE}, " + signed("(SELECT page_id, w FROM w)", "page_id", runs("w", 5), 64, 7)
oracle("page_dedupe", f"{_PAGE}, {banded(0.8, 64)}, {PAIRS}, nd AS (SELECT page_id AS node FROM pages), {components('c', 'nd')} {DECIDED.format(key='page_id')}")
_AUDIT = f"""{_both(0.3)}, {EXACT}, g AS (SELECT b.item_id AS query, count(ex.b) AS candidate_count, count(*) FILTER (WHERE jaccard >= 0.1) > 0 AS matched,
    coalesce(string_agg(CAST(ex.b AS VARCHAR), ',' ORDER BY ex.b) FILTER (WHERE jaccard >= 0.1), '') AS reference_matches FROM benchmark b LEFT JOIN ex ON ex.a = b.item_id + 1000000000 GROUP BY 1)"""
oracle("contamination_audit", f"WITH {_AUDIT} SELECT * FROM g")
oracle("audit_summary", f"""WITH {_AUDIT} SELECT count(*) AS queries, CAST(sum(candidate_count) AS BIGINT) AS candidates, count(*) FILTER (WHERE matched) AS matched,
    CAST(count(*) FILTER (WHERE matched) AS DOUBLE) / count(*) AS overlap_rate, 1 - CAST(sum(candidate_count) AS DOUBLE) / (count(*) * (SELECT count(*) FROM documents)) AS candidate_reduction FROM g""")

# --- entities, weights, sets -----------------------------------------------------------------------------------------

_CUST = f"(SELECT c_custkey, c_custkey % 500 AS label, {words('c_mktsegment')} AS aw, 'c' || CAST(c_custkey % 500 AS VARCHAR) || '@example.com' AS mail FROM customer)"
_CUSTF = "list_concat(list_transform(aw, lambda x: 'address:word:' || x), ['email:exact:' || mail, 'email:domain:example.com', 'phone:exact:' || CAST(label AS VARCHAR)])"
_CUSTP = f"{signed(_CUST, 'c_custkey', _CUSTF, 128, 7)}, {banded(0.4, 128)}, {PAIRS}"
oracle("entity_customer_pairs", f"WITH {_CUSTP} SELECT a, b FROM c")
oracle("entity_quality", f"""WITH {_CUSTP} SELECT (SELECT count(*) FROM c) AS candidates, (SELECT count(*) FROM c WHERE a % 500 = b % 500) AS hits,
    (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT count(*) AS n FROM customer GROUP BY c_custkey % 500)) AS pairs""")
_PRODF = f"list_concat(list_transform({words('p_name')}, lambda x: 'title:word:' || x), ['brand:exact:' || regexp_replace({FOLD.format(t='p_brand')}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')], list_transform({words('p_type')}, lambda x: 'category:word:' || x))"
oracle("entity_product_pairs", f"WITH {signed('part', 'p_partkey', _PRODF, 64, 7)}, {banded(0.8, 64)}, {PAIRS} SELECT a, b FROM c")
oracle("weighted_jaccard_tokens", f"""
    WITH p AS (SELECT p_partkey, lower(p_name) AS t FROM part),
    n AS (SELECT p_partkey AS key, token, count(*) AS n FROM (SELECT p_partkey, unnest(string_split(t, '')) AS token FROM p) GROUP BY ALL), {_NEXT},
    e AS (SELECT a, b, token, n AS x, 0 AS y FROM q JOIN n ON key = a UNION ALL SELECT a, b, token, 0, n FROM q JOIN n ON key = b),
    x AS (SELECT a, b, token, sum(x) AS x, sum(y) AS y FROM e GROUP BY ALL)
    SELECT a, b, CAST(sum(least(x, y)) AS DOUBLE) / sum(greatest(x, y)) AS similarity FROM x GROUP BY ALL""")
_bits = " + ".join(f"CASE WHEN b{i} >= 0 THEN {(1 << i) - (1 << 64) if i == 63 else 1 << i}::HUGEINT ELSE 0 END" for i in range(64))
_votes = ", ".join(f"sum(CASE WHEN (v >> {i}) & 1 = 1 THEN n ELSE -n END) AS b{i}" for i in range(64))
oracle("simhash_tokens", f"""WITH w AS (SELECT user_id AS key, event_type AS token, count(*) AS n FROM events GROUP BY ALL), v AS (SELECT key, n, {le('sha256(token)', 8)} AS v FROM w),
    s AS (SELECT key, {_votes} FROM v GROUP BY key) SELECT key, CAST({_bits} AS BIGINT) AS simhash FROM s""")
for _d in (3, 7):
    oracle(f"hamming_links_{_d}", f"""WITH w AS (SELECT key, token, count(*) AS n FROM (SELECT doc_id AS key, unnest({words('text')}) AS token FROM documents) GROUP BY ALL),
        v AS (SELECT key, n, {le('sha256(token)', 8)} AS v FROM w), s AS (SELECT key, {_votes} FROM v GROUP BY key),
        h AS (SELECT doc_id, CAST({_bits} AS BIGINT) AS code FROM documents LEFT JOIN s ON key = doc_id),
        k AS (SELECT code, min(doc_id) AS class_id FROM h WHERE code IS NOT NULL GROUP BY code),
        l AS (SELECT x.code, count(*) AS n FROM k x JOIN k y ON x.code <> y.code AND bit_count(xor(x.code, y.code)) <= {_d} GROUP BY 1)
        SELECT doc_id, class_id, coalesce(n, 0) AS n_links FROM h LEFT JOIN k USING (code) LEFT JOIN l USING (code)""")
oracle("hamming_similarity_pairs", f"""WITH o AS ({ORACLES['simhash_tokens']})
    SELECT x.key AS a, y.key AS b, 1 - bit_count(xor(x.simhash, y.simhash)) / 64.0::DOUBLE AS similarity FROM o x JOIN o y ON y.key = x.key + 1""")
_SETS = "(SELECT l_orderkey, list(DISTINCT CAST(l_partkey % 40 AS VARCHAR)) AS items FROM lineitem GROUP BY 1)"
oracle("integer_set_groups", f"""WITH RECURSIVE {signed(_SETS, 'l_orderkey', 'items', 64, 1)}, {banded(0.8, 64)}, an AS (SELECT band, bucket, min(key) AS a FROM bd GROUP BY ALL),
    c AS (SELECT DISTINCT an.a, bd.key AS b FROM bd JOIN an USING (band, bucket) WHERE bd.key <> an.a), nd AS (SELECT DISTINCT l_orderkey AS node FROM lineitem), {components('c', 'nd')} {_SUMMARY}""")

# --- stored index ----------------------------------------------------------------------------------------------------

oracle("contains_many", "SELECT p_partkey AS key, p_partkey % 2 = 0 AS present FROM part")
oracle("insert_reject_duplicates", "SELECT p_partkey AS key FROM part WHERE p_partkey % 3 <> 1")
oracle("remove_keys", "SELECT p_partkey AS key FROM part WHERE p_partkey % 7 <> 3")
oracle("compacted_index", "SELECT p_partkey AS key, 0 AS gen FROM part WHERE p_partkey % 11 <> 0")
oracle("index_verify", "SELECT * FROM (VALUES ('repeated_keys', 0::BIGINT), ('wrong_lengths', 0::BIGINT), ('wrong_buckets', 0::BIGINT), ('orphan_removals', 0::BIGINT)) t(problem, n)")
_LIVE = f"(SELECT p_partkey, {folded('CASE WHEN p_partkey % 10 = 0 THEN reverse(p_name) ELSE p_name END')} AS t FROM part WHERE p_partkey % 5 <> 0 OR p_partkey % 10 = 0)"
oracle("reinsert_generation", f"WITH {signed(_LIVE, 'p_partkey', chars('t', 3), 32, 1)} SELECT key, value AS first FROM s WHERE pos = 0")
_NAMES = signed("(SELECT p_partkey, " + folded("p_name") + " AS t FROM part)", "p_partkey", chars("t", 3), 32, 1)
oracle("index_search_topk", f"""WITH {_NAMES}, {banded(0.8, 32)},
    c AS (SELECT DISTINCT x.key AS a, y.key AS b FROM bd x JOIN bd y ON x.band = y.band AND x.bucket = y.bucket AND x.key % 50 = 0), {SIMILAR},
    r AS (SELECT a AS query, b AS key, similarity, CAST(row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS INTEGER) AS rank FROM sc WHERE similarity >= 0.5) SELECT * FROM r WHERE rank <= 3""")

oracle("index_without_signatures", f"""WITH {_NAMES}, {banded(0.8, 32)}
    SELECT DISTINCT x.key AS query, y.key AS key FROM bd x JOIN bd y ON x.band = y.band AND x.bucket = y.bucket AND x.key % 50 = 0""")
_URLS = signed("(SELECT page_id, " + folded("url") + " AS t FROM pages)", "page_id", chars("t", 3), 32, 1)
oracle("index_bucket_lookup", f"""WITH {_URLS}, {banded(0.8, 32)}
    SELECT DISTINCT x.key AS query, y.key AS key FROM bd x JOIN bd y ON x.band = y.band AND x.bucket = y.bucket AND x.key % 100 = 0
    WHERE y.key % 7 <> 0 OR y.key % 21 = 0""")
_LIVE_URLS = signed("(SELECT page_id, " + folded("url") + " AS t FROM pages WHERE page_id % 5 <> 0 OR page_id % 15 = 0)", "page_id", chars("t", 3), 32, 1)
oracle("incremental_groups", f"""WITH RECURSIVE {_LIVE_URLS}, {banded(0.8, 32)}, {PAIRS}, nd AS (SELECT key AS node FROM sig), {components('c', 'nd')} {DECIDED.format(key='page_id')}""")
_UPPER = "page_id > (SELECT max(page_id) // 2 FROM pages)"
_MERGED = f"(SELECT page_id, {folded(f'CASE WHEN {_UPPER} AND page_id % 21 = 0 THEN reverse(url) ELSE url END')} AS t FROM pages WHERE NOT ({_UPPER}) OR page_id % 7 <> 0 OR page_id % 21 = 0)"
oracle("merged_index", f"WITH {signed(_MERGED, 'page_id', chars('t', 3), 32, 1)} SELECT key, value AS first FROM s WHERE pos = 0")
_BURST = signed("events", "event_id", "['user:' || CAST(user_id AS VARCHAR), 'type:' || event_type]", 32, 1)
oracle("streaming_bucket_sessions", f"""WITH RECURSIVE {_BURST}, {banded(0.8, 32)},
    near AS (SELECT key AS b, ts, lag(key) OVER w AS a, lag(ts) OVER w AS before FROM bd JOIN events ON event_id = key WINDOW w AS (PARTITION BY band, bucket ORDER BY ts, key)),
    c AS (SELECT DISTINCT a, b FROM near WHERE ts - before <= INTERVAL 6 HOUR), nd AS (SELECT event_id AS node FROM events), {components('c', 'nd')} {DECIDED.format(key='event_id')}""")
_fold = f"list_reduce(list_prepend({FNV[0]}::UBIGINT, list_transform(bucket, lambda v: v::UBIGINT)), lambda h, v: {mul64('xor(h, v)', f'{FNV[1]}::UHUGEINT')})"
oracle("band_hashes_published", f"""WITH {_NAMES}, {banded(0.8, 32)},
    b0 AS (SELECT key, band, xor({_fold}, 10::UBIGINT) AS h FROM bd), b1 AS (SELECT key, band, {mul64('xor(h, h >> 33)', f"'{FMIX64[0]}'::UHUGEINT")} AS h FROM b0),
    b2 AS (SELECT key, band, {mul64('xor(h, h >> 33)', f"'{FMIX64[1]}'::UHUGEINT")} AS h FROM b1)
    SELECT key, CAST(band AS INTEGER) AS band, lpad(lower(printf('%x', xor(h, h >> 33))), 16, '0') AS bucket FROM b2""")

# --- plans and reports -----------------------------------------------------------------------------------------------

_curve = "1 - pow(1 - pow({s}, {r}), {b})"
oracle("candidate_probability_curve", f"SELECT i / 20.0::DOUBLE AS similarity, round({_curve.format(s='(i / 20.0::DOUBLE)', r=13, b=9)}, 9) AS probability FROM range(21) t(i)")
oracle("tune_params", """
    WITH g AS (SELECT t.threshold, p.num_perm, b.bands, r.nrows FROM (VALUES (0.2::DOUBLE), (0.4), (0.5), (0.8), (0.9)) t(threshold), (VALUES (64), (128)) p(num_perm),
         range(1, 129) b(bands), range(1, 129) r(nrows) WHERE b.bands * r.nrows <= p.num_perm),
    x AS (SELECT g.*, i, CAST(CASE WHEN i IN (0, 64) THEN 1.0 WHEN i % 2 = 0 THEN 2.0 ELSE 4.0 END AS DOUBLE) AS weight FROM g, range(0, 65) s(i)),
    e AS (SELECT threshold, num_perm, bands, nrows,
         sum(weight * (1 - pow(1 - pow(threshold * i / 64.0::DOUBLE, nrows), bands))) * threshold / 64 / 3 AS below,
         sum(weight * pow(1 - pow(threshold + (1 - threshold) * i / 64.0::DOUBLE, nrows), bands)) * (1 - threshold) / 64 / 3 AS above FROM x GROUP BY threshold, num_perm, bands, nrows),
    k AS (SELECT *, row_number() OVER (PARTITION BY threshold, num_perm ORDER BY round((below + above) / 2, 12), bands * nrows DESC) AS n FROM e)
    SELECT threshold, CAST(num_perm AS INTEGER) AS num_perm, CAST(bands AS INTEGER) AS bands, CAST(nrows AS INTEGER) AS rows FROM k WHERE n = 1""")


oracle("storage_recommendation", """
    WITH x AS (SELECT m.mode, b.budget, 1608000000 <= b.budget AS fits, 768000000 <= b.budget AS stored
         FROM (VALUES ('auto'), ('memory'), ('persistent'), ('lazy'), ('redis')) m(mode), (VALUES (NULL::BIGINT), (1099511627776), (1073741824), (1048576)) b(budget))
    SELECT mode, coalesce(budget, -1) AS budget, CASE WHEN mode IN ('persistent', 'lazy', 'redis') THEN mode WHEN budget IS NULL THEN CASE mode WHEN 'auto' THEN 'persistent' ELSE 'memory' END
         WHEN fits THEN 'memory' WHEN stored THEN 'persistent' ELSE 'redis' END AS storage,
         CASE WHEN mode IN ('persistent', 'lazy') THEN CASE WHEN budget IS NOT NULL AND NOT stored THEN 'explicit_mode_exceeds_budget' ELSE 'explicit_mode' END
         WHEN mode = 'redis' THEN 'explicit_mode' WHEN budget IS NULL THEN CASE mode WHEN 'auto' THEN 'capacity_unknown' ELSE 'explicit_mode' END
         WHEN fits THEN 'in_memory_fits_budget' WHEN stored THEN 'in_memory_exceeds_budget' ELSE 'local_metadata_exceeds_budget' END AS reason FROM x""")
_S = "(SELECT sum((CASE WHEN i IN (0, 64) THEN 1.0 WHEN i % 2 = 0 THEN 2.0 ELSE 4.0 END)::DOUBLE * {f}) * {w} / 64 / 3 FROM range(0, 65) t(i))"
oracle("plan_report", f"""
    WITH x(n, budget) AS (VALUES (1000000::BIGINT, NULL::BIGINT), (1000000, 2147483648), (10000000, 8589934592), (10000000, 1048576))
    SELECT n AS expected_items, 0.8::DOUBLE AS threshold, 128 AS num_perm, 9 AS bands, 13 AS rows, 'tuned' AS parameter_source, 117 AS used_permutations, 11 AS unused_permutations,
      round({_curve.format(s='0.8::DOUBLE', r=13, b=9)}, 9) AS candidate_probability_at_threshold, round(pow(1 - pow(0.5::DOUBLE, 1.0::DOUBLE / 9), 1.0::DOUBLE / 13), 9) AS similarity_at_50_percent_candidates,
      round({_S.format(f="(1 - pow(1 - pow(0.8::DOUBLE * i / 64, 13), 9))", w="0.8::DOUBLE")}, 9) AS false_positive_area,
      round({_S.format(f="pow(1 - pow(0.8::DOUBLE + 0.2::DOUBLE * i / 64, 13), 9)", w="0.2::DOUBLE")}, 9) AS false_negative_area,
      9::BIGINT AS bucket_memberships_per_item, 512::BIGINT AS signature_bytes_per_item, n * 512 AS signature_bytes, 152::BIGINT AS index_metadata_bytes_per_item, n * 152 AS index_metadata_bytes,
      1072::BIGINT AS in_memory_index_bytes_per_item, n * 1072 AS in_memory_index_bytes, 440::BIGINT AS persistent_index_bytes_per_item, 736 + n * 440 AS persistent_index_bytes,
      512::BIGINT AS lazy_resident_bytes_per_item, n * 512 AS lazy_resident_bytes, n * 1608 AS in_memory_with_headroom_bytes, n * 768 AS lazy_with_headroom_bytes, coalesce(budget, -1) AS memory_budget_bytes,
      coalesce(CAST(n * 1608 <= budget AS VARCHAR), 'unknown') AS in_memory_fits_budget, coalesce(CAST(n * 768 <= budget AS VARCHAR), 'unknown') AS persistent_fits_budget, 'auto' AS requested_storage,
      CASE WHEN budget IS NULL THEN 'persistent' WHEN n * 1608 <= budget THEN 'memory' WHEN n * 768 <= budget THEN 'persistent' ELSE 'redis' END AS recommended_storage,
      CASE WHEN budget IS NULL THEN 'capacity_unknown' WHEN n * 1608 <= budget THEN 'in_memory_fits_budget' WHEN n * 768 <= budget THEN 'in_memory_exceeds_budget' ELSE 'local_metadata_exceeds_budget' END AS recommendation_reason FROM x""")
oracle("latency_percentiles", """WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders)
    SELECT min(v) FILTER (WHERE i = ceil((n - 1) * 50 / 100.0)) AS p50, min(v) FILTER (WHERE i = ceil((n - 1) * 95 / 100.0)) AS p95, min(v) FILTER (WHERE i = ceil((n - 1) * 99 / 100.0)) AS p99 FROM r""")
oracle("report_comparison", """WITH e AS (SELECT event_type AS metric, event_id % 2 AS side, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY ALL),
    x AS (SELECT a.metric, 'rows' AS unit, CASE WHEN a.metric < 'm' THEN 'lower' ELSE 'higher' END AS direction, a.value AS before, b.value AS after FROM e a JOIN e b ON a.metric = b.metric AND a.side = 0 AND b.side = 1)
    SELECT *, round(CASE WHEN direction = 'lower' THEN -1 ELSE 1 END * (after - before) / abs(before) * 100, 9) AS improvement_percent FROM x""")
