"""A stored index whose duplicate groups stay current: labels by generation, changed for the components that a batch touches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, lsh
from ..operators.tables import scratch, shared_table
from .index import StoredIndex

#: Generations of labels beyond which a commit folds them into one.
MOST_LABELS = 16


class GroupedIndex(StoredIndex):
    """An index that also keeps, for every key, the component it is in: records that share a bucket are linked.

    A component's label is its smallest key.  Labels are written in the commit that changes the index, as a generation of rows
    ``key, component`` (null for a key that is gone) of those keys alone whose label is new; for a key the last generation counts.

    A batch that is inserted looks its buckets up, and joins the components of the members it finds: an edge leads from a new key to
    each such component's label, so what is computed has the size of the batch.  A removal computes the components of what is left of the
    components it touches from their buckets, since a bucket links its members whoever of them goes.  Other labels are neither
    shuffled nor written; finding a key's or a component's rows scans the columns of labels.
    """

    def _labels(self, name: str) -> DataFrame:
        return self.spark.read.schema("key bigint, component bigint").parquet(f"{self.path}/{name}")

    def _label_history(self) -> DataFrame:
        out = self.spark.createDataFrame([], "key bigint, component bigint, at int")
        for i, name in enumerate(self.meta.get("labels", [])):
            out = out.unionAll(self._labels(name).withColumn("at", F.lit(i)))
        return out

    def components(self) -> DataFrame:
        """``node, component`` of all keys that are in the index."""
        self._check()
        last = self._label_history().groupBy("key").agg(F.max_by(F.struct("component"), "at").alias("x"))
        return last.where("x.component is not null").select(F.col("key").alias("node"), "x.component")

    def decisions(self) -> DataFrame:
        """``key, keep, representative`` of all keys."""
        found = self.components()
        return found.select(F.col("node").alias("key"), (F.col("node") == F.col("component")).alias("keep"), F.col("component").alias("representative"))

    def _current(self, keys: DataFrame) -> DataFrame:
        """``key, component`` of the keys asked for (distinct)."""
        rows = self._label_history().join(keys, "key", "left_semi")
        return rows.groupBy("key").agg(F.max_by(F.struct("component"), "at").alias("x")).where("x.component is not null").select("key", "x.component")

    def _inside(self, labels: DataFrame) -> DataFrame:
        """``key, component`` of the members of some components (``component``, distinct)."""
        named = self._label_history().join(labels, "component", "left_semi").select("key").distinct()
        return self._current(named).join(labels, "component", "left_semi").select("key", "component")

    def _commit(self, name: str, instead: bool = False) -> None:
        if instead:
            super()._commit(name, True)
            return
        with scratch():
            delta = self._changed(self._generation(name))
            written = f"labels-{uuid.uuid4().hex}"
            delta.select("key", "component").repartition("key").sortWithinPartitions("key").write.parquet(f"{self.path}/{written}")
        before = self.meta
        self.meta = before | {"labels": [*before.get("labels", []), written]}
        try:
            super()._commit(name)
        except Exception:
            self.meta = before
            self._discard(written)
            raise
        if len(self.meta["labels"]) > MOST_LABELS:
            self.fold_labels()

    def fold_labels(self) -> None:
        """Write the labels as one generation, sorted by ranges of keys, and commit it."""
        written = f"labels-{uuid.uuid4().hex}"
        self.components().select(F.col("node").alias("key"), "component").repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{self.path}/{written}")
        self._publish(self.meta | {"version": self.meta["version"] + 1, "labels": [written]})

    def _changed(self, staged: DataFrame) -> DataFrame:
        """``key, component`` of the keys whose labels a staged generation changes; it holds either new keys or removed ones."""
        gone = staged.where("removed").select("key")
        return self._joined(staged) if gone.isEmpty() else self._split(gone)

    def _joined(self, new: DataFrame) -> DataFrame:
        banded = shared_table(lsh.stored_bands(new.select("key", "buckets"), "key"), "banded")
        asked = banded.select(F.col("key").alias("query"), "band", "bucket")
        met = shared_table(self._members(asked).select("query", "key").distinct(), "met")
        labels = shared_table(self._current(met.select("key").distinct()), "labels")
        to_old = met.join(labels, "key").select(F.col("query").alias("a"), F.col("component").alias("b"))
        # A key without a partner has an edge to itself, so that it gets a label.
        edges = to_old.unionAll(lsh.anchor_pairs(banded)).unionAll(new.select(F.col("key").alias("a"), F.col("key").alias("b")))
        found = shared_table(graph.components(edges), "found")
        fresh = new.select(F.col("key").alias("node")).join(found, "node").select(F.col("node").alias("key"), "component")
        old = shared_table(labels.select("component").distinct(), "old")
        moved = old.join(found.withColumnRenamed("component", "least"), F.col("component") == F.col("node")).where("least <> component").select("component", "least")
        moved = shared_table(moved, "moved")
        members = self._inside(moved.select("component")).join(moved, "component").select("key", F.col("least").alias("component"))
        return fresh.unionAll(members)

    def _split(self, gone: DataFrame) -> DataFrame:
        gone = shared_table(gone, "gone")
        touched = shared_table(self._current(gone).select("component").distinct(), "touched")
        left = shared_table(self._inside(touched).join(gone, "key", "left_anti").select("key", "component"), "left")
        rows = self._rows_of(left.select("key"))
        found = graph.components(lsh.anchor_pairs(shared_table(lsh.stored_bands(rows, "key"), "banded")))
        every = graph.with_singletons(found, left, "key").select(F.col("node").alias("key"), F.col("component").alias("least"))
        changed = left.join(every, "key").where("least <> component").select("key", F.col("least").alias("component"))
        return changed.unionAll(gone.select("key", F.lit(None).cast("bigint").alias("component")))
