"""Candidates of an exact similarity join: classes of equal sets, and pairs of classes that share a feature of their prefixes.

Features are put in one order, rare ones first.  Two sets with a Jaccard similarity of at least ``least`` share c = ceil(least * n) features
or more, n being the size of either, so the first m of those are among the first n - c + m of each.  With m = MANY, or c where that is
less, pairs that share fewer in these prefixes are out.  This holds whatever the order is, which only decides how many pairs are looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lsh import alike
from .skew import BLOCK, blocks_of
from .tables import free_shuffles, shared_table

#: Rows of the sample that tells frequent features, for the order alone, and how many features are told.
SAMPLE_ROWS, FREQUENT = 10_000, 1 << 17

#: Features that the prefixes of two sets must share, where sets have as many.
MANY = 6

#: Pairs that a task brings together to count them.
PAIRS = 1 << 22

#: Pairs for each feature that a round of the prefix join looks at, on average, and parts that keys are dealt to rounds in.
ROUND_PAIRS, ROUND_PARTS = 1 << 32, 1 << 16

#: Features that one side of a cell holds, and pairs for each feature that a cell counts, on average.
CELL_FEATURES, CELL_PAIRS = 1 << 22, 1 << 26

#: Rows of pairs that a task hands on at a time.
ROWS = 1 << 18

#: Room for rounding where a size is compared with a share of another.
SLACK = 1e-9


def hashed(features: Column) -> Column:
    """Distinct 64-bit hashes of features, which are told apart by them within two sets."""
    return F.array_distinct(F.transform(features, lambda f: F.xxhash64(f)))


def sets(records: DataFrame, key: str, features: Column) -> DataFrame:
    """``key, h``: the hashes of every set."""
    return records.select(F.col(key).alias("key"), hashed(features).alias("h"))


def classes(found: DataFrame) -> DataFrame:
    """``key, head, size`` from ``sets`` that are not empty: the smallest key of equal sets (128 bits and their number of features), and how
    many there are."""
    mark = F.struct(F.size("h").alias("n"), F.md5(F.array_join(F.array_sort("h").cast("array<string>"), ",")).alias("x"))
    # Written first, and only then filtered: features would be made once for each use.
    marks = shared_table(found.select("key", mark.alias("mark")), "marks").where("mark.n > 0")
    return shared_table(alike(marks, "mark").select("key", "head", "size"), "sets")


def frequent(found: DataFrame, rows: int) -> np.ndarray:
    """The most frequent features of a sample, ascending by their number.  Without any of them pairs would be the same, found with more work."""
    part = found.where(F.pmod(F.xxhash64("key", F.lit("order")), F.lit(max(1, rows // SAMPLE_ROWS))) == 0)
    counted = part.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 2")
    counted = counted.orderBy(F.desc("n"), "h").limit(FREQUENT).select("h").toArrow()
    return counted.column("h").to_numpy()[::-1]


def _least(least: float, n: np.ndarray) -> np.ndarray:
    return np.ceil(least * n - SLACK).astype(np.int64)


def _needed(least: float, n: np.ndarray) -> np.ndarray:
    return np.clip(_least(least, n), 1, MANY)


def prefixes(found: DataFrame, least: float, common: np.ndarray) -> DataFrame:
    """``key, n, h``: a row for each feature of a set's prefix; n is the set's size."""
    place = np.argsort(common, kind="stable")
    ordered = common[place]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("h")
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            h = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(n)), n)
            rank = np.full(len(h), -1)
            if len(ordered):
                at = np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)
                rank = np.where(ordered[at] == h, place[at], -1)
            order = np.lexsort((h, rank, row))
            within = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            first = within < np.repeat(n - _least(least, n) + _needed(least, n), n)
            row = row[first]  # rows stay together in the order, so places within them are the same
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row)), pa.array(n[row].astype(np.int32)), pa.array(h[order][first])], ["key", "n", "h"])

    kind = found.schema["key"].dataType.simpleString()
    return found.select("key", "h").mapInArrow(run, f"key {kind}, n int, h bigint")


def _sharing(least: float, x: pa.ListArray, y: pa.ListArray, rounds: int = 1, at_round: int = 0) -> Iterator[pa.Table]:
    """``a, b, n, needed`` (a < b) of each list of x and the one of y beside it, or itself where that is null, whose sizes allow a similarity
    of ``least``: how many lists have the two, and how many must at least, which is less than MANY for small sets.  A pair belongs to the
    round of its smaller key, and only those of ``at_round`` are looked for."""
    own, other = pc.list_flatten(x), pc.list_flatten(y)
    keys = pa.concat_arrays([own.field("k"), other.field("k")])
    known = keys.unique()
    known = known.take(pc.sort_indices(known))
    code = pc.index_in(keys, value_set=known).to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.concatenate([c.field("n").to_numpy(zero_copy_only=False) for c in (own, other)])
    ends = [np.cumsum(pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False)) for c in (x, y)]
    starts, alone = [e - np.diff(e, prepend=0) for e in ends], pc.is_null(y).to_numpy(zero_copy_only=False)
    size = np.zeros(len(known), np.int64)
    size[code] = n
    mine = np.concatenate([c.field("part").to_numpy(zero_copy_only=False) for c in (own, other)]) % rounds == at_round
    held: list[np.ndarray] = []

    def counted() -> pa.Table:
        each, times = np.unique(np.concatenate(held), return_counts=True)
        u, v = each // len(known), each % len(known)
        needed = np.minimum(_needed(least, size[u]), _needed(least, size[v]))
        return pa.table({"a": known.take(pa.array(u)), "b": known.take(pa.array(v)), "n": pa.array(times), "needed": pa.array(needed)})

    room = 0
    for i in range(len(x)):
        left = np.arange(starts[0][i], ends[0][i])
        right = left if alone[i] else np.arange(starts[1][i], ends[1][i]) + len(own)
        left = left[mine[left]] if alone[i] else left
        for at in range(0, len(left), BLOCK):
            p, q = np.repeat(left[at : at + BLOCK], len(right)), np.tile(right, len(left[at : at + BLOCK]))
            fits = (n[p] >= least * n[q] - SLACK) & (n[q] >= least * n[p] - SLACK)
            if not alone[i]:
                fits &= np.where(code[p] < code[q], mine[p], mine[q])
            u, v = code[p[fits]], code[q[fits]]
            # Within one list each pair comes from both sides.
            held.append((u * len(known) + v)[u < v] if alone[i] else (np.minimum(u, v) * len(known) + np.maximum(u, v))[u != v])
            room += len(held[-1])
            if room > PAIRS:
                yield counted()
                held, room = [], 0
    if held:
        yield counted()


def prefix_pairs(found: DataFrame, least: float, rows: int) -> Iterator[DataFrame]:
    """``a, b`` (a < b), distinct, of ``sets``, none of them empty, that share a feature of their prefixes; ``rows`` is about how many sets there
    are.  The pairs come in rounds, by their smaller key, as many as keep what a round looks at bounded: most pairs that share a feature share
    too few, but which is known only when their numbers from all lists have met.

    What shares a feature is a list.  Lists with one smallest key meet in one task, since near copies share very many features, so a pair
    leaves it once with their number and not for each of them; lists beyond BLOCK are dealt out in blocks by key, the same ones for every feature."""
    kind = found.schema["key"].dataType.simpleString()
    part = F.pmod(F.xxhash64("key", F.lit("round")), F.lit(ROUND_PARTS)).cast("int").alias("part")
    shared = prefixes(found, least, frequent(found, rows)).repartition("h").groupBy("h").agg(F.collect_list(F.struct(F.col("key").alias("k"), "n", part)).alias("x")).where("size(x) > 1")
    shared = shared_table(shared.select(F.array_min("x.k").alias("anchor"), "x"), "shared")
    free_shuffles(found.sparkSession)
    pairs = shared.agg(F.coalesce(F.sum(F.expr("double(size(x)) * (size(x) - 1) / 2")), F.lit(0.0))).first()[0]
    rounds = min(ROUND_PARTS, max(1, math.ceil(pairs / ROUND_PAIRS)))
    one = F.lit(None).cast(shared.schema["x"].dataType)
    # A power of two, so that blocks of lists of like sizes are the same.
    parts = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("x") / F.lit(BLOCK)))).cast("int")
    block = lambda i: F.filter("x", lambda e: F.pmod(F.xxhash64(e["k"]), F.col("parts")) == i)
    large = shared.where(F.size("x") > BLOCK).withColumn("parts", parts).withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    large = large.withColumn("hi", F.explode(F.sequence("lo", F.col("parts") - 1)))
    large = large.select("anchor", "lo", "hi", block(F.col("lo")).alias("x"), F.when(F.col("lo") != F.col("hi"), block(F.col("hi"))).otherwise(one).alias("y"))
    small = shared.where(F.size("x") <= BLOCK).select("anchor", F.lit(0).alias("lo"), F.lit(0).alias("hi"), "x", one.alias("y"))

    lists = small.unionAll(large).repartition("anchor", "lo", "hi").sortWithinPartitions("anchor").select("x", "y")

    def one_round(r: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for out in _sharing(least, batch.column("x"), batch.column("y"), rounds, r):
                    yield from out.to_batches()

        met = lists.mapInArrow(run, f"a {kind}, b {kind}, n bigint, needed bigint")
        return met.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("needed").alias("needed")).where("n >= needed").select("a", "b")

    yield from map(one_round, range(rounds))


def _cell(least: float, x: pa.Table, y: pa.Table | None) -> Iterator[pa.Table]:
    """``a, b, jaccard`` (a < b) of the members of any row of x and any of y whose sets, of ``n`` features and ``f`` that others have, reach
    ``least``; without y those of x among each other, a row's own members being equal.  Pairs are counted PAIRS at a time."""
    sides = [t.combine_chunks() for t in ((x,) if y is None else (x, y))]
    lists = [pa.concat_arrays([c.chunk(i) for i in range(c.num_chunks)]) if c.num_chunks else pa.array([], c.type) for t in sides for c in (t.column("f"), t.column("members"))]
    sizes = [pc.list_value_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in lists]
    f, row = [pc.list_flatten(c).to_numpy(zero_copy_only=False) for c in lists[::2]], [np.repeat(np.arange(len(n)), n) for n in sizes[::2]]
    n = [t.column("n").to_numpy().astype(np.int64) for t in sides]
    keys = pa.concat_arrays([pc.list_flatten(c) for c in lists[1::2]])
    rank = np.empty(len(keys), np.int64)
    rank[pc.sort_indices(keys).to_numpy()] = np.arange(len(keys))
    held, starts = sizes[1::2], [np.cumsum(m) - m for m in sizes[1::2]]
    if y is not None:
        starts[1] = starts[1] + held[0].sum()

    def rows(u: np.ndarray, v: np.ndarray, j: np.ndarray, within: bool) -> Iterator[pa.Table]:
        each = held[0][u] * held[-1][v]
        upto = np.cumsum(each)
        at = 0
        while at < len(u):
            end = max(at + 1, int(np.searchsorted(upto, upto[at] - each[at] + ROWS, "right")))
            k = np.repeat(np.arange(at, end), each[at:end])
            place = np.arange(len(k)) - np.repeat(upto[at:end] - each[at:end] - (upto[at] - each[at]), each[at:end])
            p, q = starts[0][u[k]] + place // held[-1][v[k]], starts[-1][v[k]] + place % held[-1][v[k]]
            if within:
                k, p, q = (z[rank[p] < rank[q]] for z in (k, p, q))
            less = rank[p] < rank[q]
            yield pa.table({"a": keys.take(pa.array(np.where(less, p, q))), "b": keys.take(pa.array(np.where(less, q, p))), "jaccard": pa.array(j[k])})
            at = end

    if y is None and least <= 1:
        several = np.flatnonzero(held[0] > 1)
        yield from rows(several, several, np.ones(len(several)), True)
    order = np.argsort(f[-1], kind="stable")
    other, of = f[-1][order], row[-1][order]
    lo = np.searchsorted(other, f[0], "left")
    times = np.searchsorted(other, f[0], "right") - lo
    upto = np.append(0, np.cumsum(np.bincount(row[0], times, len(n[0])).astype(np.int64)))
    ends = np.append(0, np.cumsum(sizes[0]))
    at = 0
    while at < len(n[0]):
        # A row has no more pairs than the other side has features, so one alone has room.
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, "right")) - 1)
        part = slice(ends[at], ends[end])
        many = times[part]
        v = of[np.repeat(lo[part] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        u = np.repeat(row[0][part], many)
        if y is None:
            u, v = u[u < v], v[u < v]
        each, both = np.unique((u - at) * len(n[-1]) + v, return_counts=True)
        u, v = each // len(n[-1]) + at, each % len(n[-1])
        j = both / (n[0][u] + n[-1][v] - both)
        yield from rows(u[j >= least], v[j >= least], j[j >= least], False)
        at = end


def counted_pairs(found: DataFrame, least: float) -> DataFrame:
    """``a, b, jaccard`` (a < b) of all keys of ``sets`` (written, for they are read several times) that share a feature and reach ``least`` > 0.

    Where a few shared features suffice, prefixes are whole sets and almost all pairs that share any are looked at.  So pairs are never
    written nor exchanged: rows are dealt to groups, every two groups meet in a cell of their own, and a cell counts what its rows share and
    lists their pairs as they are found.  A row goes to as many cells as there are groups; there are as many as the square root of the pairs
    asks for, so what is exchanged grows as the rows and that root do.  Rows are classes of equal sets with up to BLOCK members, and only
    their features that others have travel."""
    kind = found.schema["key"].dataType.simpleString()
    lists = blocks_of(classes(found)).join(found.select(F.col("key").alias("head"), F.size("h").alias("n"), "h"), "head")
    lists = shared_table(lists.select(F.array_min("members").alias("row"), "members", "n", "h"), "lists")
    each = lists.select("row", F.size("members").alias("m"), F.explode("h").alias("f"))
    several = shared_table(each.groupBy("f").agg(F.sum("m").alias("m"), F.count("*").alias("n")).where("m > 1").select("f", "n"), "several")
    features, pairs = several.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.expr("double(n) * (n - 1) / 2")), F.lit(0.0))).first()
    groups = max(1, -(-features // CELL_FEATURES), math.ceil(math.sqrt(2 * pairs / CELL_PAIRS)))
    own = each.select("row", "f").join(several.select("f"), "f", "left_semi").groupBy("row").agg(F.collect_list("f").alias("f"))
    group = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("group")
    rows = shared_table(own.join(lists.select("row", "members", "n"), "row").select(group, "members", "n", "f"), "rows")
    free_shuffles(found.sparkSession)
    meeting = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("other")
    dealt = rows.select("group", "members", "n", "f", meeting).withColumn("cell", F.least("group", "other") * groups + F.greatest("group", "other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if table.num_rows:
            cell = table.column("cell")[0].as_py()
            lo, hi = cell // groups, cell % groups
            x, y = (table.filter(pc.equal(table.column("group"), g)).select(["members", "n", "f"]) for g in (lo, hi))
            for out in _cell(least, x, None if lo == hi else y):
                yield from out.to_batches()

    # A number of tasks that is given stays as it is: a cell's bytes don't tell its work.
    tasks = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups * (groups + 1) // 2)
    return dealt.drop("other").repartition(tasks, "cell").groupBy("cell").applyInArrow(run, f"a {kind}, b {kind}, jaccard double")
