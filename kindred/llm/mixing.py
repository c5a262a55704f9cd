"""Mixing of sources to target weights: Efraimidis-Spirakis keys, prefix sums to budgets, complete epochs before a fraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.tables import scratch, shared_table
from .fill_middle import first_units, marked

#: Words, as those whose number is a document's size.
SPACE_WORDS = r"[^\x20\x09-\x0D]+"

#: Words with the white space before them; white space at the end of a text is a unit of its own.
CUT_WORDS = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"


def running_totals(rows: DataFrame, by: list[str], order: list[Column], values: dict[str, Column], name: str) -> DataFrame:
    """``rows`` with running sums of ``values``, in ``order``, within groups of equal ``by`` (nulls are equal), the row itself included.

    Rows are sorted into ranges of (by, order) over all tasks, however large one group is; each range's totals, one row
    for each group in it, tell what the ranges before hold, and a running sum within the range adds to that."""
    ranged = rows.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_part", F.spark_partition_id())
    ranged = shared_table(ranged, name)
    totals = ranged.groupBy("_part", *by).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in values.items()])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("_part").alias("_g__part"), *[F.col(c).alias(f"_g_{c}") for c in by], *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in values])
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = ranged.withColumns({n: F.sum(c).over(inside) for n, c in values.items()})
    on = F.col("_part") == F.col("_g__part")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return found.join(totals, on).select(*rows.columns, *[(F.col(n) + F.col(f"_b_{n}")).alias(n) for n in values])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: int = 3) -> DataFrame:
    """``source, source_size, target`` of ``source, source_size`` (a row for each source).

    Sources in order of their code points, null last, weigh ``weights``, repeating; they share ``share`` of all sizes.  A target
    stops at ``most`` times its source's size, and the excess goes to the others by weight until none is above.

    In order of most * size / weight the sources that stop come first: one stops if its bound is no more than its part of what those
    before it leave.  So running sums find them all, in whole numbers."""
    if not weights or min(weights) < 1 or not 0 <= share <= most or most < 1:
        raise ValueError("weights are positive whole numbers, and the share is within 0 and the most that sources give")
    ranked = running_totals(sizes.withColumn("_null", F.col("source").isNull()), [], [F.col("_null"), F.col("source")], {"_rank": F.lit(1)}, "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", "_rank", weight.cast("long").alias("_weight"))
    all_sizes, all_weights = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_weight"), F.lit(0))).first()
    total = F.lit(all_sizes) if share == 1.0 else F.lit(int(round(all_sizes * share)))
    bound = F.col("source_size") * most
    ratio = (bound.cast("double") / F.col("_weight")).alias("_ratio")
    sums = running_totals(ranked.withColumn("_ratio", ratio), [], [F.col("_ratio"), F.col("_rank")], {"_sizes": bound, "_weights": F.col("_weight")}, "bounds")
    rest, others = total - (F.col("_sizes") - bound), F.lit(all_weights) - (F.col("_weights") - F.col("_weight"))
    exact = lambda c: c.cast("decimal(19,0)")
    sums = shared_table(sums.withColumns({"_rest": rest, "_others": others, "_stops": exact(bound) * exact(others) <= exact(F.col("_weight")) * exact(rest)}), "targets")
    level = sums.where(~F.col("_stops")).agg(F.min_by(F.struct("_rest", "_others"), F.struct("_ratio", "_rank"))).first()[0]
    target = bound.cast("double")
    if level is not None:
        target = F.when(F.col("_stops"), target).otherwise(F.col("_weight") * (F.lit(level["_rest"]).cast("double") / F.lit(level["_others"])))
    return sums.select("source", "source_size", target.alias("target"))


def letter_share(text: Column) -> Column:
    """A document's quality weight from its text: the share of its code points that are letters, 0.01 at least."""
    letters = F.length(F.regexp_replace(text, r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", ""))
    return F.greatest(F.lit(0.01), F.coalesce(letters / F.nullif(F.length(text), F.lit(0)), F.lit(0.0)))


def draw(key: Column, seed: int) -> Column:
    """A number above 0 and up to 1 by the sha256 of ``<seed>:<key>``; a null key is hashed as no characters."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 1.0) / F.lit(float(1 << 48))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None,
    weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: int = 3, seed: int = 13,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source_size, target, taken, epochs, extra, source``.

    ``size`` is the number of words, ``target`` that of the words the mix wants of the row's source (``source_targets``).  A source gives
    ``epochs`` complete passes over its documents, and then a sample without replacement for what is left: each document has the key
    -ln(u) / quality, u being a hash of seed and id, and in order of their keys documents give all their words while those before
    them leave room; the last gives what room there is (``extra`` of its first words).  ``taken`` is epochs * size + extra.  So a source's
    taken words are its target, rounded, and no document gives more than ``most`` times its size.

    ``quality`` is a positive weight of each row (``letter_share`` of its text if none is given); nulls and what is not positive count
    as 0.01.  A null or empty text has size 0 and gives nothing; a null source is a source of its own.  Rows that repeat an id have
    one u; ties of keys are broken by id, size and the text's hash, and rows that agree in all may change places.  An empty table
    gives an empty result; only the columns named are read, so no name can clash.  No source is brought into one task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    good = F.coalesce(letter_share(text) if quality is None else quality.cast("double"), F.lit(0.01))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(SPACE_WORDS)).cast("long").alias("size"),
        F.xxhash64(text).alias("_hash"), (-F.log(draw(F.col(id_col), seed)) / F.when(good > 0, good).otherwise(0.01)).alias("_key"),
    )
    with scratch() as own:
        rows = shared_table(rows, "sizes")
        sizes = shared_table(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
        targets = source_targets(sizes, weights, share, most)
        order = [F.col("_key"), F.col("doc_id"), F.col("size"), F.col("_hash")]
        sums = running_totals(rows, ["source"], order, {"_upto": F.col("size")}, "keys")
        targets = targets.withColumnRenamed("source", "_source")
        joined = sums.join(targets, F.col("source").eqNullSafe(F.col("_source")))
        budget = F.round("target").cast("long")
        whole = F.when(F.col("source_size") > 0, F.expr("CAST(round(target) AS BIGINT) div source_size")).otherwise(0).cast("long")
        left = budget - whole * F.col("source_size") - (F.col("_upto") - F.col("size"))
        extra = F.greatest(F.lit(0), F.least("size", left)).cast("long")
        return own.keep(joined.select(
            "doc_id", "size", "source_size", "target", (whole * F.col("size") + extra).alias("taken"), whole.alias("epochs"), extra.alias("extra"), "source"
        ), "mix")


def mixed_texts(docs: DataFrame, mix: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, copy, text``: the mix itself, a row for each copy of a document that gives words.

    The whole text for each complete epoch (copy 0, 1 …), then the first ``extra`` words.  For tables whose ids are unique and not null."""
    planned = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(
        mix.where("taken > 0").select("doc_id", "epochs", "extra", "size"), "doc_id"
    )
    copies = planned.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - F.when(F.col("extra") > 0, 0).otherwise(1))))
    part = (F.col("copy") == F.col("epochs")) & (F.col("extra") < F.col("size"))
    return copies.select("doc_id", "copy", F.when(part, first_units(marked(F.col("text"), CUT_WORDS), F.col("extra").cast("int"))).otherwise(F.col("text")).alias("text"))


