"""Links between 64-bit sketches that differ in few bits, by the pigeonhole principle on bits.

A mask is a set of bits.  With d + 1 masks that share no bit, two sketches that differ in at most d bits agree under one of them, so
pairs are looked for among sketches that agree under a mask.  Where many do, the bits that the mask leaves are cut into d + 1 masks
again, for the same reason; what is crowded even then is dealt out in blocks.  A pair that agrees under several masks counts at the
first one, which is told from the two sketches, so that pairs needn't be brought together to be made distinct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from .skew import BLOCK, met_within, with_group
from .tables import shared_table

#: Times that the bits which are left are cut again in a crowded bucket, and the largest distance.
CUTS, MOST_BITS = 2, 15

_EVERY = list(range(64))


def distance(a: Column | str, b: Column | str) -> Column:
    """Number of bits in which two BIGINT differ."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def _signed(bits: list[int]) -> int:
    value = sum(1 << i for i in bits)
    return value - (1 << 64) if value >> 63 else value


def parts(left: list[int], d: int) -> list[list[int]]:
    """The bits ``left`` in d + 1 runs that share none, as even as can be."""
    n = d + 1
    return [left[len(left) * i // n : len(left) * (i + 1) // n] for i in range(n)]


def classes(codes: DataFrame) -> DataFrame:
    """``code, class_id, size`` from ``key, code``: the smallest key of equal codes, and how many rows have it."""
    known = codes.where("code is not null")
    return known.groupBy("code").agg(F.min("key").alias("class_id"), F.count("*").alias("size"))


def close_codes(codes: DataFrame, d: int) -> DataFrame:
    """``a, b, distance`` (a < b) of the distinct values of ``code`` that differ in at most ``d`` bits, all of them.

    Values are compared once each, however many rows have one; nulls are passed over and an empty table has no pairs.  Work grows with
    the members of buckets, which random sketches fill evenly; sketches that agree in almost all bits are compared in blocks of BLOCK."""
    if not 0 <= d <= MOST_BITS:
        raise ConfigurationError(f"a distance must lie within 0 and {MOST_BITS}")
    spark = codes.sparkSession
    own = shared_table(codes.where("code is not null").select("code").distinct(), "codes")
    out = own.select(F.col("code").alias("a"), F.col("code").alias("b")).where(F.lit(False))
    # Each cut's masks by number: two ways of cutting may lead to one mask, and a pair counts on one way alone.
    first = parts(_EVERY, d)
    cuts = [(held, [_signed(q) for q in first[:i]]) for i, held in enumerate(first)]
    masks = F.array(*[F.struct(F.lit(n).alias("way"), F.lit(_signed(held)).cast("bigint").alias("mask")) for n, (held, _) in enumerate(cuts)])
    rows = own.select("code", F.inline(masks))
    for cut in range(CUTS + 1):
        rows = rows.select("way", "code", F.col("code").bitwiseAND(F.col("mask")).alias("value"))
        sized = with_group(rows, ["way", "value"], F.col("code"), {"n": F.count("*")}, {"size": F.sum("n")}).where("size > 1")
        sized = shared_table(sized, "sized")
        crowded = sized.where(F.col("size") > BLOCK * (d + 1))  # cutting makes d + 1 rows of one, dealing out one for each block
        last = cut == CUTS or crowded.isEmpty()
        ready = sized if last else sized.where(F.col("size") <= BLOCK * (d + 1))
        met = met_within(ready, ["way", "value"], "code").where(distance("a", "b") <= d)
        # Earlier masks in columns; a way that has fewer is filled up with all bits, under which no two values agree.
        width = d * (cut + 1)
        earlier = [(n, *(before + [-1] * (width - len(before)))) for n, (_, before) in enumerate(cuts)]
        known = spark.createDataFrame(earlier, ", ".join(["way int", *[f"e{i} bigint" for i in range(width)]]))
        met = met.join(F.broadcast(known), "way")  # (d + 1) ** (cut + 1) rows
        for i in range(width):
            met = met.where(F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(F.col(f"e{i}")) != 0)
        out = out.unionAll(met.select("a", "b"))
        if last:
            break
        named, finer = [], []
        for n, (held, before) in enumerate(cuts):
            under = [held + p for p in parts([i for i in _EVERY if i not in held], d)]
            for i, bits in enumerate(under):
                named.append((n, len(finer), _signed(bits)))
                finer.append((bits, before + [_signed(u) for u in under[:i]]))
        masks = spark.createDataFrame(named, "way int, next int, mask bigint")
        rows = crowded.select("code", "way").join(F.broadcast(masks), "way").select("code", F.col("next").alias("way"), "mask")
        cuts = finer
    return out.select("a", "b", distance("a", "b").alias("distance"))


#: Distance from which on links are counted in blocks: so many sketches agree under masks of few bits that looking for pairs costs more
#: than comparing all.  Then the codes of a block, and blocks along a side of the tiles that tasks work on.
DENSE_BITS, CODES, TILES = 5, 1 << 14, 16


def _counts(x: np.ndarray, y: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of y lie within ``d`` bits of each of x, and of x of each of y; some rows at a time, so no matrix of all is held."""
    of_x, of_y, step = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), 32
    for at in range(0, len(x), step):
        near = np.bitwise_count(x[at : at + step, None] ^ y[None, :]) <= d
        of_x[at : at + step] = np.bitwise_count(np.packbits(near, axis=1)).sum(axis=1, dtype=np.int64)
        of_y += np.add.reduce(near.view(np.uint8), axis=0, dtype=np.uint8)
    return of_x, of_y


def link_counts(codes: DataFrame, d: int) -> DataFrame:
    """``_code, n_links`` of distinct codes that have another within ``d`` bits, all compared in blocks of CODES, in all tasks.

    Its work is the square of the number of codes, a few instructions each; pairs are neither listed nor exchanged.  Codes are sorted, and
    two blocks whose codes all differ in more than ``d`` bits that each has in common are passed over."""
    own = shared_table(codes.where("code is not null").select("code").distinct(), "codes")
    number = own.count()
    blocks = max(1, -(-number // CODES), min(TILES, number // 256))
    held = own.repartitionByRange(blocks, "code").withColumn("block", F.spark_partition_id()).groupBy("block")
    held = shared_table(held.agg(F.collect_list("code").alias("codes"), F.bit_and("code").alias("ones"), F.bit_or("code").alias("any")), "blocks")
    left = held.select(F.col("block").alias("lo"), F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))).alias("hi"), "ones", "any")
    right = held.select(F.col("block").alias("hi"), F.col("ones").alias("_ones"), F.col("any").alias("_any"))
    apart = F.bit_count(F.col("ones").bitwiseAND(F.bitwise_not("_any")).bitwiseOR(F.col("_ones").bitwiseAND(F.bitwise_not("any"))))
    met = left.join(right, "hi").where(apart <= d).select("lo", "hi")
    met = met.join(held.select(F.col("block").alias("lo"), F.col("codes").alias("x")), "lo").join(held.select(F.col("block").alias("hi"), F.col("codes").alias("y")), "hi")
    side = max(1, blocks // TILES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lo, hi = batch.column("lo")[i].as_py(), batch.column("hi")[i].as_py()
                x, y = (batch.column(c)[i].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in ("x", "y"))
                of_x, of_y = _counts(x, y, d)
                for c, n in [(x, of_x - 1)] if lo == hi else [(x, of_x), (y, of_y)]:  # a code lies within any distance of itself
                    yield pa.RecordBatch.from_arrays([pa.array(c[n > 0].view(np.int64)), pa.array(n[n > 0])], ["_code", "n"])

    tiles = met.repartition(min(TILES, blocks) ** 2, (F.col("lo") / side).cast("int"), (F.col("hi") / side).cast("int"))
    return tiles.mapInArrow(run, "_code bigint, n bigint").groupBy("_code").agg(F.sum("n").alias("n_links"))


def linked(codes: DataFrame, d: int) -> DataFrame:
    """``key, class_id, n_links`` of every row of ``key, code``: the smallest key with the same code, and the number of other classes within ``d`` bits.

    A row without a code has no class and no links.  Copies are not expanded: the pairs behind are those of ``close_codes``, or compared in blocks
    and counted alone from DENSE_BITS on."""
    codes = codes.select("key", "code")
    if not 0 <= d <= MOST_BITS:
        raise ConfigurationError(f"a distance must lie within 0 and {MOST_BITS}")
    if d >= DENSE_BITS:
        ends = link_counts(codes, d)
    else:
        ends = close_codes(codes, d).select(F.explode(F.array("a", "b")).alias("_code")).groupBy("_code").agg(F.count("*").alias("n_links"))
    grouped = with_group(codes.where("code is not null"), ["code"], F.col("key"), {"least": F.min("key")}, {"class_id": F.min("least")})
    known = grouped.join(ends, F.col("code") == F.col("_code"), "left").select("key", "class_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    none = codes.where("code is null").select("key", F.lit(None).cast(codes.schema["key"].dataType).alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return known.unionAll(none)
