"""Duplicate groups: connected components over edges, groups, representatives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DedupeError, InvalidRepresentativeError
from .skew import with_group
from .tables import shared_table

#: Edges up to which one task, in an executor, finds the components; beyond it they are found in rounds over all tasks.
FEW_EDGES = 1 << 20


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of at most FEW_EDGES edges: minimum labels go along the edges and jump to their label's label."""
    read = [b for b in batches if b.num_rows]
    if not read:
        return
    table = pa.Table.from_batches(read)
    every = pa.chunked_array([*table.column("a").chunks, *table.column("b").chunks])
    nodes = pc.unique(every)
    nodes = nodes.take(pc.sort_indices(nodes))
    a, b = (pc.index_in(table.column(c), value_set=nodes).to_numpy(zero_copy_only=False) for c in ("a", "b"))
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], least)
        np.minimum.at(after, label[b], least)
        while not np.array_equal(jumped := after[after], after):
            after = jumped
        if np.array_equal(after, label):
            break
        label = after
    yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(label))], ["node", "component"])


def components(edges: DataFrame, rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """``node, component`` for every node of the edges ``a, b``; the component is its smallest node.

    Few edges (their number is counted) go to one task.  More are re-linked in rounds: neighbours to the smallest one known,
    from large to small and back, until nothing changes; rounds grow with the logarithm of a component's diameter.  Minima
    are aggregated map-side and joined back under a salt, so neither a hub nor a giant component lands in one task.
    Each round is written to the shared folder: a lost executor costs no round.  Self edges give components of one; repeated
    edges change nothing; null ends are left out.
    """
    e = shared_table(edges.select("a", "b").where("a is not null and b is not null").distinct(), "edges")
    kind = e.schema["a"].dataType.simpleString()
    if e.limit(few + 1).count() <= few:
        return e.repartition(1).mapInArrow(_in_one_task, f"node {kind}, component {kind}")
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    e = e.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    for _ in range(rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_group(both, ["u"], F.col("v"), {"m": F.min("v")}, {"m": F.min("m")})
        large = large.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        small = with_group(large, ["u"], F.col("v"), {"m": F.min("v")}, {"m": F.min("m")})
        links = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        e = shared_table(small.select(F.explode(links).alias("e")).select("e.u", "e.v").where("u <> v").distinct(), "edges")
        # Settled: every node has one edge, and it leads to a node that has none of its own.
        forks = e.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("w")).where("v <> w").select("u", "v")
        chains = e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v")
        if forks.unionAll(chains).isEmpty():
            return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("_least")), "node", "left").select(
                "node", F.coalesce("_least", "node").alias("component")
            )
    raise DedupeError(f"components did not settle in {rounds} rounds")


def members(found: DataFrame, min_size: int = 2) -> DataFrame:
    """``component, node, size`` of components with ``min_size`` members or more, a row for each member: a group of any size."""
    sized = with_group(found, ["component"], F.col("node"), {"n": F.count("*")}, {"size": F.sum("n")})
    return sized.where(F.col("size") >= max(1, min_size)).select("component", "node", "size")


def groups(found: DataFrame, min_size: int = 2) -> DataFrame:
    """``representative, members, size`` of components with ``min_size`` members or more; members ascend, joined by commas.

    A list of members is one value, so it is for groups that a task can hold; ``members`` has them as rows."""
    out = found.groupBy("component").agg(F.array_sort(F.collect_set("node")).alias("members"))
    out = out.where(F.size("members") >= max(1, min_size))
    return out.select(F.col("component").alias("representative"), F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), F.size("members").cast("bigint").alias("size"))


def with_singletons(found: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Components of all keys; a key without edges is its own."""
    all_keys = keys.select(F.col(key).alias("node")).distinct()
    return all_keys.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


Selector = Callable[[pd.DataFrame], object]


def representatives(found: DataFrame, records: DataFrame, key: str, prefer: Column | Selector) -> DataFrame:
    """``component, representative``: the member that ``prefer`` chooses.

    A Column is a preference: the largest wins (nulls last), then the smallest key; it is aggregated map-side.  A function
    gets each component's records, in order of their keys, and returns the key of one of them; it needs a component in one task.
    A key that is not a member is an InvalidRepresentativeError."""
    if isinstance(prefer, Column):
        rows = found.join(records.select(F.col(key).alias("node"), prefer.alias("_prefer")), "node")
        best = rows.groupBy("component").agg(F.max("_prefer").alias("_best"))
        return rows.join(best, "component").where(F.col("_prefer").eqNullSafe(F.col("_best"))).groupBy("component").agg(F.min("node").alias("representative"))
    kind = found.schema["node"].dataType.simpleString()

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        component = group["_component"].iloc[0]
        return pd.DataFrame({"component": [component], "representative": [prefer(group.drop(columns="_component").sort_values(key, ignore_index=True))]})

    rows = records.join(found.select(F.col("node").alias(key), F.col("component").alias("_component")), key)
    chosen = shared_table(rows.groupBy("_component").applyInPandas(choose, f"component {kind}, representative {kind}"), "chosen")
    wrong = chosen.join(found.select("component", F.col("node").alias("representative")), ["component", "representative"], "left_anti").limit(1).collect()
    if wrong:
        raise InvalidRepresentativeError(f"the representative {wrong[0].representative} is not in the group of {wrong[0].component}")
    return chosen


def decisions(found: DataFrame, keys: DataFrame, key: str, chosen: DataFrame | None = None) -> DataFrame:
    """``key, keep, representative`` for every key, singletons included; ``chosen`` has other representatives than the smallest keys."""
    every = with_singletons(found, keys, key)
    if chosen is not None:
        every = every.join(chosen, "component", "left").select("node", F.coalesce("representative", "component").alias("component"))
    return every.select(F.col("node").alias(key), (F.col("node") == F.col("component")).alias("keep"), F.col("component").alias("representative"))
