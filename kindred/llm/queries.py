"""Registered queries of the operators, with production parameters, over whole tables, and their SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import align, decontaminate, exact_dedup, fill_middle, line_dedup, mixing, ngram_join, packing, pitman_yor, quality, secrets, token_count, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    counts = [secrets.number_of(F.col("base"), kind).alias(f"n_{kind}") for kind in secrets.KINDS[:3]]
    every = F.array_sort(F.concat("base", "random"), secrets.in_order)
    return found.select("doc_id", *counts, F.sha2(secrets.joined(F.array_sort("base", secrets.in_order)), 256).alias("base_sha256"), secrets.joined(every).alias("spans"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_texts(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: Dated entries of three lists: list, domain, action, verdict, day.  Days count from the first fetch.  The driver's tables hold
#: no lists; ``filter_urls`` takes them from any table with these columns.
URL_LISTS = [
    ("spam", "cheap-pills.example.com", "add", "block", 0),
    ("spam", "cheap-pills.example.com", "remove", "block", 900),
    ("spam", "cheap-pills.example.com", "add", "block", 1400),
    ("spam", "free-bets.example.com", "add", "block", 200),
    ("spam", "blog.tionsh.example.net", "add", "block", 100),
    ("spam", "blog.tionsh.example.net", "remove", "block", 130),
    ("ads", "ads-track.example.com", "add", "block", 50),
    ("ads", "m.ads-track.example.com", "add", "allow", 700),
    ("ads", "free-bets.example.com", "add", "block", 600),
    ("adult", "adult-x.example.net", "add", "block", 0),
    ("adult", "blog.adult-x.example.net", "add", "allow", 300),
    ("adult", "blog.adult-x.example.net", "remove", "allow", 1100),
    ("adult", "example.org", "add", "block", 1500),
    ("adult", "example.org", "remove", "block", 1510),
]

_LISTS = ", ".join(f"('{a}', '{b}', '{c}', '{d}', {e})" for a, b, c, d, e in URL_LISTS)

#: Pages hold no time of their fetch; their ids stand for it, one page of each day's 1800 in turn.
FETCH_DAYS = 1800


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = spark.sql(f"SELECT list, key, action, verdict, CAST(at AS BIGINT) AS at FROM VALUES {_LISTS} AS e(list, key, action, verdict, at)")
    fetched = F.pmod(F.col("page_id"), F.lit(FETCH_DAYS)).cast("long")
    found = url_filter.filter_urls(table(spark, sf_dir, "pages"), lists, "page_id", "url", fetched)
    return found.withColumnRenamed("id", "page_id").withColumnRenamed("fetched", "fetch_day")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact_dedup.exact_groups(docs, digest=True)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_token_counts": op3_token_counts,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_decontamination": op5_decontamination,
    "op6_url_filter": op6_url_filter,
    "op7_line_dedup": op7_line_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
    "op11_fill_middle": op11_fill_middle,
    "op12_alignment": op12_alignment,
    "op13_mixing": op13_mixing,
}

ORACLES: dict[str, str] = {
    "op2_ngram_jaccard": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
               ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS grams FROM w),
        g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
        h AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb
               FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM h WHERE 100 * shared >= 90 * (na + nb - shared)),
        c(doc_id, component_id) USING KEY (doc_id) AS (
            SELECT doc_id, doc_id FROM s
            UNION SELECT l.b, min(c.component_id) FROM c JOIN l ON c.doc_id = l.a JOIN recurring.c AS o ON o.doc_id = l.b
                  WHERE c.component_id < o.component_id GROUP BY l.b)
        SELECT s.doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN c USING (doc_id)
    """,
    "op5_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
        i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
        iw AS (SELECT item_id, least(10, len(words)) AS n, unnest(list_transform(range(1, len(words) - least(10, len(words)) + 2),
               lambda p: array_to_string(words[p : p + least(10, len(words)) - 1], ' '))) AS win FROM i WHERE len(words) > 0),
        ns AS (SELECT DISTINCT n FROM iw),
        dp AS (SELECT doc_id, n, words, unnest(range(1, len(words) - n + 2)) AS p FROM d, ns WHERE len(words) >= n),
        dw AS (SELECT doc_id, n, p, array_to_string(words[p : p + n - 1], ' ') AS win FROM dp),
        m AS (SELECT DISTINCT doc_id, item_id, dw.n, p FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
        hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY 1),
        it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
               FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY 1)
        SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
    """,
    "op6_url_filter": f"""
        WITH e(list, key, action, verdict, day) AS (VALUES {_LISTS}),
        i AS (SELECT *, lead(day) OVER (PARTITION BY list, key ORDER BY day) AS until FROM e),
        p AS (SELECT page_id, CAST(page_id % {FETCH_DAYS} AS BIGINT) AS fetch_day,
              nullif(regexp_replace(regexp_extract(lower(url), '{url_filter.HOST}', 1), '[.]+$', ''), '') AS host FROM pages),
        k AS (SELECT page_id, fetch_day, unnest(list_transform(range(1, len(string_split(host, '.')) + 1),
              lambda x: array_to_string(list_slice(string_split(host, '.'), x, len(string_split(host, '.'))), '.'))) AS key FROM p),
        m AS (SELECT page_id, key, verdict, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM k JOIN i USING (key)
              WHERE action = 'add' AND day <= fetch_day AND (until IS NULL OR fetch_day < until) GROUP BY ALL),
        b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(key) DESC, verdict) AS n FROM m)
        SELECT p.page_id, p.host, p.fetch_day, coalesce(b.verdict = 'block', false) AS blocked, b.verdict, b.key AS matched, b.lists
        FROM p LEFT JOIN b ON p.page_id = b.page_id AND b.n = 1
    """,
    "op7_line_dedup": r"""
        WITH d AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        k AS (SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM d),
        r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        j AS (SELECT k.*, r.last IS NOT NULL AND r.last <> k.doc_id AS dropped FROM k LEFT JOIN r USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM j GROUP BY doc_id
    """,
    "op8_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
        FROM d JOIN g USING (text)
    """,
    "op11_fill_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
               sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        k AS (SELECT doc_id, text, units, len(units) AS n, list_transform([1, 9, 17, 25], lambda p: CAST('0x' || substr(h, p, 8) AS BIGINT)) AS h FROM d),
        c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS i, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS j,
               CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
                    WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k),
        p AS (SELECT doc_id, text, n, form, array_to_string(units[1:i], '') AS pre, array_to_string(units[i + 1:j], '') AS mid,
               array_to_string(units[j + 1:n], '') AS suf FROM c)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
               sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid
                      ELSE text END) AS output_sha256, sha256(text) AS restored_sha256
        FROM p
    """,
    "op13_mixing": r"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        k AS (SELECT doc_id, source, size, -ln((CAST('0x' || substr(sha256('13:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 1.0::DOUBLE) / 281474976710656.0::DOUBLE)
               / greatest(0.01::DOUBLE, coalesce(length(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]+', '', 'g'))::DOUBLE / nullif(length(text), 0), 0)) AS key FROM d),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
        w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight FROM s),
        o AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / CAST(weight AS DOUBLE), source NULLS LAST) AS place FROM w),
        r AS (SELECT *, (SELECT sum(source_size) FROM o) - coalesce(sum(3 * source_size) OVER b, 0) AS rest,
               (SELECT sum(weight) FROM o) - coalesce(sum(weight) OVER b, 0) AS others FROM o
               WINDOW b AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT *, 3 * source_size * others <= weight * rest AS stops FROM r),
        l AS (SELECT rest, others FROM t WHERE NOT stops ORDER BY place LIMIT 1),
        g AS (SELECT source, source_size, CASE WHEN stops THEN CAST(3 * source_size AS DOUBLE)
               ELSE weight * (CAST((SELECT rest FROM l) AS DOUBLE) / CAST((SELECT others FROM l) AS DOUBLE)) END AS target FROM t),
        u AS (SELECT k.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
        e AS (SELECT u.*, source_size, target, CAST(round(target) AS BIGINT) AS budget,
               CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS epochs
               FROM u JOIN g ON u.source IS NOT DISTINCT FROM g.source)
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
               CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken FROM e
    """,
}
