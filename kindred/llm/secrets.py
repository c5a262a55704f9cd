"""Secret scans: three fixed patterns and a randomness test battery with false-discovery control.  Native functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_table

# Fixed patterns of the base scan; Java's (?i) without (?u) changes case in ASCII alone.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_CHARS = 6
# Runs are maximal, so a least length in the pattern drops exactly the shorter matches.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

#: Candidates of the battery: maximal runs of at least LEAST such characters, with padding that ends there, and as long parts of
#: a run between SEPARATORS.
LEAST, SEPARATORS = 20, "[-_/]"
TOKEN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}+(?:={{1,2}}+(?![A-Za-z0-9+/_=-]))?"

#: Encodings in the order in which they are tried: pattern of the token without padding, alphabet.
ENCODINGS = {
    "hex": (r"^(?=.*[0-9])(?=.*[A-Fa-f])([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    "dashed hex": (r"^(?=.*[0-9])(?=.*[A-Fa-f])([0-9a-f]+(-[0-9a-f]+)+|[0-9A-F]+(-[0-9A-F]+)+)$", "0123456789abcdef"),
    "base32": (r"^(?=.*[A-Z])(?=.*[2-7])[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base26": (r"^([a-z]+|[A-Z]+)$", "abcdefghijklmnopqrstuvwxyz"),
    "base36": (r"^(?=.*[A-Za-z])(?=.*[0-9])([a-z0-9]+|[A-Z0-9]+)$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    "base38": (r"^(?=.*[a-z])(?=.*[-_])[a-z0-9_-]+$", "0123456789abcdefghijklmnopqrstuvwxyz-_"),
    "base52": (r"^[A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    "base64": (r"^(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
}

#: Steps of the p values whose counts the false-discovery control looks at, and bands of token length.
BINS, BANDS = 100, 16


def _matches(text: Column, pattern: str, kind: str, value: int | None = None, least: int = 0) -> Column:
    """array<struct<start, end, kind, token>> of the leftmost non-overlapping matches, in code points.

    Positions come from the lengths of the pieces between the matches.  Texts without a match are searched once."""
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(value or 0)).alias("value"),
    )
    none = F.array().cast("array<struct<start:int,end:int,kind:int,token:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("kind"), x["value"].alias("token"))
        out = F.when(F.length(x["value"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(none)


def _with_parts(spans: Column) -> Column:
    """The spans, and the parts of each between separators that are long enough to be candidates."""

    def parts(span: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            end = acc["at"] + F.length(x)
            part = F.struct(acc["at"].alias("start"), end.alias("end"), span["kind"].alias("kind"), x.alias("token"))
            return F.struct((end + 1).alias("at"), F.when(F.length(x) >= LEAST, F.concat(acc["out"], F.array(part))).otherwise(acc["out"]).alias("out"))

        none = F.array().cast("array<struct<start:int,end:int,kind:int,token:string>>")
        cut = F.split(span["token"], SEPARATORS, -1)
        found = F.aggregate(cut, F.struct(span["start"].alias("at"), none.alias("out")), step)["out"]
        return F.concat(F.array(span), F.when(F.size(cut) > 1, found).otherwise(none))

    return F.flatten(F.transform(spans, parts))


def _outermost(spans: Column) -> Column:
    """The spans without those that lie in a longer one."""
    return F.filter(spans, lambda s: ~F.exists(spans, lambda t: (t["start"] <= s["start"]) & (s["end"] <= t["end"]) & (t["end"] - t["start"] > s["end"] - s["start"])))


def _upper_tail(z: Column) -> Column:
    """P(normal > z) by a logistic curve, exact to about 1e-4."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1 / (1 + F.exp(1.5976 * z + 0.070566 * z * z * z))


def _judged(tokens: DataFrame) -> DataFrame:
    """``tokens`` (with a column ``token``) that have an inferred encoding, with its number, their length band and ``p``.

    ``p`` is the probability that a token drawn evenly from its alphabet would do no better in three tests: chi-squared
    of the symbol counts (Wilson-Hilferty), Wald-Wolfowitz runs of low and high symbols, lag-one serial correlation;
    combined by Fisher's method.  Each step is a column of its own, so that no expression is repeated in another.
    """
    bare = F.regexp_replace("token", "=+$", "")
    wide = F.translate(bare, "-_", "+/")
    encoding, plain, alphabet = F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, (pattern, symbols)) in reversed(list(enumerate(ENCODINGS.items()))):
        low = F.lower(bare)
        text = {"hex": low, "dashed hex": F.replace(low, F.lit("-"), F.lit("")), "base26": low, "base36": low, "base64": wide}.get(name, bare)
        fits = F.rlike(wide if name == "base64" else bare, F.lit(pattern))
        encoding, plain = F.when(fits, i).otherwise(encoding), F.when(fits, text).otherwise(plain)
        alphabet = F.when(fits, F.lit(symbols)).otherwise(alphabet)
    out = tokens.select("*", encoding.alias("encoding"), plain.alias("plain"), alphabet.alias("symbols")).where("encoding is not null")
    band = F.least(F.lit(BANDS - 1), F.floor(2 * F.log2(F.length("token").cast("double"))).cast("int") - 8)
    out = out.select("*", band.alias("band"), F.length("plain").cast("double").alias("n"), F.length("symbols").cast("double").alias("k"), F.split("plain", "").alias("letters"))
    out = out.select(
        "*",
        F.expr("aggregate(array_distinct(letters), 0.0D, (s, c) -> s + power(n - length(replace(plain, c, '')), 2))").alias("squares"),
        F.expr("transform(letters, c -> cast(instr(symbols, c) as double))").alias("values"),
    )
    out = out.select(
        "*",
        F.expr("array_join(transform(values, v -> if(v > k / 2, '1', '0')), '')").alias("halves"),
        F.expr("aggregate(values, 0.0D, (s, v) -> s + v)").alias("total"),
        F.expr("aggregate(values, 0.0D, (s, v) -> s + v * v)").alias("power"),
        F.expr("aggregate(zip_with(slice(values, 1, cast(n as int) - 1), slice(values, 2, cast(n as int) - 1), (a, b) -> a * b), 0.0D, (s, v) -> s + v)").alias("lagged"),
    )
    out = out.select(
        "*",
        F.expr("(power((squares * k / n - n) / (k - 1), 1 / 3D) - (1 - 2 / (9 * (k - 1)))) / sqrt(2 / (9 * (k - 1)))").alias("z_even"),
        F.expr("n - length(replace(halves, '1', ''))").alias("high"),
        F.expr("(2 * n - length(replace(halves, '01', '')) - length(replace(halves, '10', ''))) / 2 + 1").alias("runs"),
        F.expr("lagged - (total / n) * (2 * total - element_at(values, 1) - element_at(values, -1)) + power(total / n, 2) * (n - 1)").alias("cross"),
    )
    out = out.select("*", F.expr("2 * high * (n - high) / n + 1").alias("expected"))
    out = out.select(
        "*",
        _upper_tail(F.col("z_even")).alias("p1"),
        (2 * _upper_tail(F.abs(F.expr("(runs - expected) / sqrt(greatest(1e-9D, (expected - 1) * (expected - 2) / (n - 1)))")))).alias("p2"),
        (2 * _upper_tail(F.abs(F.expr("cross / greatest(1e-9D, power - total * total / n) * sqrt(n)")))).alias("p3"),
    )
    out = out.select("*", F.expr("-(ln(greatest(1e-12D, least(1D, p1))) + ln(greatest(1e-12D, least(1D, p2))) + ln(greatest(1e-12D, least(1D, p3))))").alias("y"))
    return out.select(*tokens.columns, "encoding", "band", F.expr("exp(-y) * (1 + y + y * y / 2)").alias("p"))


def thresholds(rows: list[tuple[int, int, int, int]], rate: float) -> dict[tuple[int, int], float]:
    """Least p value to report, by (encoding, length band), from counts (encoding, band, bin, tokens).

    Even draws have evenly spread p values and others pile up near 0.  So the number of even draws in a stratum is
    twice that of the tokens above one half (and one more), and the share of others among those at or above t is what
    exceeds it.  The least t is taken at which that share is within ``rate``; short and long tokens are judged apart,
    since the tests find less in short ones.  A stratum without such a t reports nothing.
    """
    strata: dict[tuple[int, int], list[int]] = {}
    for encoding, band, at, n in rows:
        strata.setdefault((encoding, band), [0] * BINS)[at] += n
    out = {}
    for key, counts in strata.items():
        even = 2 * (sum(counts[BINS // 2 :]) + 1)
        for at in range(1, BINS):
            above = sum(counts[at:])
            if above and 1 - even * (1 - at / BINS) / above <= rate:
                out[key] = at / BINS
                break
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.1) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, base, random``, both array<struct<start, end, kind, token>>.

    ``base`` holds the matches of the three patterns (spans of the whole match in code points, end exclusive; token is the
    value for ``assign``).  ``random`` holds runs of 20 or more characters of an encoding, or else their parts between ``-``, ``_``
    and ``/`` that are as long, whose three randomness tests don't
    speak against even draws, at thresholds that keep the estimated share of other tokens within ``rate`` in each length
    band; those that overlap base spans are left out.  A null text is empty; an empty table gives an empty result; rows
    that repeat an id are scanned one by one.  The counts for the thresholds cover all rows; there are at most 8 x 16 x 100.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(_matches(text, ASSIGN, "assign", 1, ASSIGN_CHARS), _matches(text, ACCESS, "access"), _matches(text, HEX, "hex"))
    # One pass over the texts; what it finds is written, so that its row numbers stay.
    rows = docs.select(F.col(id_col).alias("doc_id"), base.alias("base"), _with_parts(_matches(text, TOKEN, "random")).alias("tokens"))
    rows = shared_table(rows.withColumn("row", F.monotonically_increasing_id()), "secrets")
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    seen = rows.where(F.size("tokens") > 0).select("row", F.explode(F.transform("tokens", lambda s: F.struct(s.alias("span"), free(s).alias("free")))).alias("x"))
    seen = seen.select("row", "x.span", "x.free", F.col("x.span.token").alias("token"))
    seen = shared_table(_judged(seen), "tokens")
    bins = F.least(F.lit(BINS - 1), F.floor(F.col("p") * BINS).cast("int")).alias("bin")
    counts = seen.groupBy("encoding", "band", bins).count().collect()
    limits = thresholds([tuple(r) for r in counts], rate)
    if not limits:
        return rows.select("doc_id", "base", F.array().cast(rows.schema["tokens"].dataType).alias("random"))
    least = F.create_map(*[F.lit(x) for (e, b), t in limits.items() for x in (e * BANDS + b, t)])
    kept = seen.where(F.col("free") & (F.col("p") >= F.element_at(least, F.col("encoding") * BANDS + F.col("band"))))
    kept = kept.groupBy("row").agg(F.array_sort(_outermost(F.collect_list("span"))).alias("random"))
    none = F.array().cast(rows.schema["tokens"].dataType)
    return rows.drop("tokens").join(kept, "row", "left").select("doc_id", "base", F.coalesce("random", none).alias("random"))


def in_order(a: Column, b: Column) -> Column:
    """By start, then kind as listed."""
    x, y = a["start"] * len(KINDS) + a["kind"], b["start"] * len(KINDS) + b["kind"]
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def number_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
