"""Ranges of keys, each in a folder of its own, so that a merge writes those that changed and links the others."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of a range (one sorted file, written by one task) after it was written; it may grow to twice as many until it is cut.
RANGE_ROWS = 1 << 18

#: The lower bound of the first range.
LOWEST = -(1 << 63)

#: A layout: lower bounds in order, with the folder that holds the range, or None for one that is to be written.
Layout = list[tuple[int, str | None]]


def number(key: Column, lows: list[int]) -> Column:
    """The range that a key lies in: the last one whose lower bound it reaches.  Keys below all bounds, and nulls, lie in the first."""
    bounds = np.array(lows[1:], dtype=np.int64)
    if not len(bounds):
        return F.lit(0)

    @F.pandas_udf("int")
    def at(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(), side="right").astype(np.int32))

    return at(F.coalesce(key, F.lit(LOWEST)))


def touched(rows: DataFrame, pieces: Layout) -> list[int]:
    """The ranges in which rows have a ``key``; one row for each range comes to the driver, which holds their list anyway."""
    at = number(F.col("key"), [low for low, _ in pieces])
    return sorted(r.at for r in rows.select(at.alias("at")).distinct().collect())


def arrange(keys: DataFrame, pieces: Layout, chosen: list[int], range_rows: int) -> Layout:
    """The layout after the ``chosen`` of the ranges have got these ``key``s: ranges without keys vanish, small neighbours become one,
    and one of more than twice ``range_rows`` is cut at quantiles of its keys."""
    lows = [low for low, _ in pieces] or [LOWEST]
    ranged = keys.select("key", number(F.col("key"), lows).alias("at"))
    counts = {r["at"]: r.n for r in ranged.groupBy("at").agg(F.count("*").alias("n")).collect()}
    groups: list[list[int]] = []
    for i in chosen:
        n, last = counts.get(i, 0), groups[-1] if groups else []
        if last and i == last[-1] + 1 and n + sum(counts.get(j, 0) for j in last) <= range_rows:
            last.append(i)
        else:
            groups.append([i])
    needs = {g[0]: -(-counts[g[0]] // range_rows) for g in groups if counts.get(g[0], 0) > 2 * range_rows}
    cuts = _cuts(ranged, needs) if needs else {}
    out: Layout = [piece for i, piece in enumerate(pieces) if i not in set(chosen)]
    for g in groups:
        if any(counts.get(i, 0) for i in g):
            out.extend((low, None) for low in [lows[g[0]], *cuts.get(g[0], [])])
    out.sort(key=lambda piece: piece[0])
    return [(LOWEST, out[0][1]), *out[1:]] if out else []


def _cuts(ranged: DataFrame, needs: dict[int, int]) -> dict[int, list[int]]:
    """Keys at which ranges are cut into as many parts as each needs; a range's lower bound is not among them."""
    most = max(needs.values())
    fractions = [i / most for i in range(1, most)]
    found = ranged.where(F.col("at").isin(list(needs))).groupBy("at")
    found = found.agg(F.percentile_approx("key", fractions, max(10_000, 20 * most)).alias("q"), F.min("key").alias("least")).collect()
    return {
        r["at"]: sorted({r.q[round(i * most / needs[r["at"]]) - 1] for i in range(1, needs[r["at"]])} - {r.least})
        for r in found
    }


def write(rows: DataFrame, path: str, layout: Layout) -> None:
    """Write rows as the layout's ranges that have no folder: each is one task's, sorted by key.

    Rows lie in those ranges alone, so their own bounds tell where."""
    lows = [low for low, folder in layout if folder is None] or [LOWEST]
    placed = rows.withColumn("range", number(F.col("key"), lows))
    placed.repartitionById(len(lows), F.col("range")).sortWithinPartitions("range", "key").write.partitionBy("range").parquet(path)


def linked(layout: Layout, name: str, there: set[str]) -> list[tuple[int, str]]:
    """The layout with the folders that ``write`` made; a range that got no rows is left out."""
    out, new = [], 0
    for low, folder in layout:
        if folder is None:
            own, new = f"range={new}", new + 1
            if own not in there:
                continue
            folder = f"{name}/{own}"
        out.append((low, folder))
    return out
