"""Line deduplication that can be undone: sharded cuckoo filters in front of exact reference counts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import scratch
from .bitmaps import bitmap, in_bitmap, split_by_bitmap
from .common import id_type, map_texts, mix, shared_table, shuffle_partitions

#: Keys that a shard's filter is meant to hold; the number of shards follows the number of repeated keys.
SHARD_KEYS = 1 << 16

SLOTS = 4
_SPACE = b" \t\n\x0b\x0c\r"


class CuckooFilter:
    """A set of 64-bit hashes with 16-bit fingerprints, four to a bucket; it can forget what it was given.

    ``has`` never denies a hash that is in it.  A filter that fills up grows to twice the size from the keys it is
    given back by ``build``; ``add`` returns False when there is no room.
    """

    def __init__(self, buckets: int) -> None:
        self.table = np.zeros((1 << max(0, buckets - 1).bit_length(), SLOTS), np.uint16)

    @staticmethod
    def build(keys: np.ndarray) -> CuckooFilter:
        buckets = max(1, len(keys) * 10 // (SLOTS * 8))
        while True:
            out = CuckooFilter(buckets)
            if all(out.add(k) for k in keys.tolist()):
                return out
            buckets *= 2

    def _places(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(np.asarray(key, np.uint64))
        prints = (h >> np.uint64(48)).astype(np.uint16)
        prints = np.where(prints == 0, np.uint16(1), prints)
        last = np.uint64(len(self.table) - 1)
        first = h & last
        return prints, first, first ^ (mix(prints.astype(np.uint64)) & last)

    def add(self, key: int) -> bool:
        prints, a, b = (int(x[0]) for x in self._places(np.array([key], np.uint64)))
        for at in (a, b):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = prints
                return True
        at, last = b, len(self.table) - 1
        moved = []
        for step in range(500):
            slot = (prints + step) % SLOTS
            moved.append((at, slot, int(self.table[at, slot])))
            prints, self.table[at, slot] = int(self.table[at, slot]), prints
            at ^= int(mix(np.array([prints], np.uint64))[0]) & last
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = prints
                return True
        for at, slot, was in reversed(moved):
            self.table[at, slot] = was
        return False

    def remove(self, key: int) -> bool:
        prints, a, b = (int(x[0]) for x in self._places(np.array([key], np.uint64)))
        for at in (a, b):
            held = np.flatnonzero(self.table[at] == prints)
            if len(held):
                self.table[at, held[0]] = 0
                return True
        return False

    def has(self, keys: np.ndarray) -> np.ndarray:
        prints, a, b = self._places(keys)
        return (self.table[a.astype(np.int64)] == prints[:, None]).any(1) | (self.table[b.astype(np.int64)] == prints[:, None]).any(1)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @staticmethod
    def from_bytes(data: bytes) -> CuckooFilter:
        out = CuckooFilter(1)
        out.table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return out


def line_key(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()


def code_points(key: bytes) -> int:
    """Code points of UTF-8 bytes: those that don't continue a character."""
    return len(key) if key.isascii() else len(key.decode("utf-8", "surrogatepass"))


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _keys(text: str, least: int) -> list[bytes]:
    """Hashes of the keys of a text's lines, None for lines that are too short to be looked at."""
    out = []
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        key = line_key(line)
        out.append(key_hash(key) if len(key) >= least and code_points(key) >= least else None)
    return out


def _postings(least: int):
    def run(docs) -> Iterator[dict]:
        for ids, texts, _ in docs:
            index, raw = [], []
            for i, text in enumerate(texts):
                own = {k for k in _keys(text, least) if k}
                index += [i] * len(own)
                raw += sorted(own)
            halves = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
            yield {"id": ids.take(pa.array(index, pa.int64())), "k1": halves[:, 0], "k2": halves[:, 1]}

    return run


def _build(table: pa.Table) -> pa.Table:
    keys = np.sort(table.column("k1").to_numpy().view(np.uint64))
    return pa.table({"shard": table.column("shard")[:1], "filter": pa.array([CuckooFilter.build(keys).to_bytes()], pa.binary())})


def _change(table: pa.Table) -> pa.Table:
    """A shard's filter with keys added and removed; null if it has no room for them."""
    old = [x for x in table.column("filter").to_pylist() if x is not None]
    keys, change = table.column("k1").to_numpy().view(np.uint64), table.column("change").to_numpy()
    found = CuckooFilter.from_bytes(old[0]) if old else None
    fits = found is not None and all(found.remove(k) for k in keys[change == -1].tolist()) and all(found.add(k) for k in np.sort(keys[change == 1]).tolist())
    return pa.table({"shard": table.column("shard")[:1], "filter": pa.array([found.to_bytes() if fits else None], pa.binary())})


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows are sorted by shard and salt, the filter before the lines: only one filter is held at a time."""
    current, found = None, None
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        salt = batch.column("salt").to_numpy()
        keys = batch.column("k1").fill_null(0).to_numpy().view(np.uint64)
        keep = np.zeros(batch.num_rows, bool)
        cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1])) + 1
        for lo, hi in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [batch.num_rows])), strict=True):
            if lo == hi:
                continue
            here = (int(shard[lo]), int(salt[lo]))
            held = batch.column("filter")[int(lo)].as_py()
            if held is not None:
                current, found = here, CuckooFilter.from_bytes(held)
                lo += 1
            if current == here:
                keep[lo:hi] = found.has(keys[lo:hi])
        yield batch.filter(pa.array(keep)).select(["id", "k1", "k2"])


class LineIndex:
    """Which documents hold which lines, kept so that documents can be added and taken away again.

    The exact table is a list of generations of rows ``id, k1, k2, change`` in the shared folder: a document holds a line or it
    doesn't, so what is inserted a second time adds nothing, and what is deleted but isn't there takes nothing away.
    ``counts`` has the documents and the largest id of each key that ``min_docs`` documents or more hold.  A change looks only at the
    keys of its own lines again (a bitmap picks their rows where they lie).  A filter for each shard holds the counted
    keys; a change adds keys to it and removes them.  A filter without room is built anew, and all are when there are
    twice as many keys as shards are meant for.  Only keys that a filter may hold are looked up in the counts.
    """

    def __init__(self, spark: SparkSession, min_chars: int = 20, min_docs: int = 3) -> None:
        self.spark, self.min_chars, self.min_docs = spark, min_chars, min_docs
        self.rows: DataFrame | None = None
        self.counts: DataFrame | None = None
        self.filters: DataFrame | None = None
        self.generations = 0
        self.shards = 1

    def _live(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("k1", "k2", "id").agg(F.sum("change").alias("refs")).where("refs > 0").drop("refs")

    def _counted(self, live: DataFrame) -> DataFrame:
        return live.groupBy("k1", "k2").agg(F.count("*").alias("docs"), F.max("id").alias("last")).where(F.col("docs") >= self.min_docs)

    def _near(self, keys: DataFrame) -> DataFrame:
        """The rows of all generations whose key may be one of ``keys``."""
        return in_bitmap(self.rows, F.col("k1"), shared_table(bitmap(keys, F.col("k1")), "line-keys"))

    def _change(self, docs: DataFrame, sign: int, id_col: str, text_col: str) -> None:
        kind = id_type(docs, id_col)
        new = map_texts(docs, _postings(self.min_chars), f"id {kind}, k1 long, k2 long", id_col, text_col).distinct()
        new = shared_table(new.withColumn("change", F.lit(sign).cast("long")), "lines")
        if self.rows is None:
            self.rows, self.generations = new.where("change > 0"), 1
            self.counts = shared_table(self._counted(self.rows), "line-counts")
            self._build_filters()
            return
        same = ["k1", "k2", "id"]
        held = self._live(self._near(new)).select(*[F.col(c).alias(f"_{c}") for c in same])
        on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same]
        new = shared_table(new.join(held, on, "left_anti" if sign > 0 else "left_semi"), "line-changes")
        self.rows, self.generations = self.rows.unionByName(new), self.generations + 1
        touched = shared_table(new.select("k1", "k2").distinct(), "line-keys")
        now = shared_table(self._counted(self._live(self._near(touched).join(touched, ["k1", "k2"], "left_semi"))), "line-counts")
        was = self.counts.join(touched, ["k1", "k2"], "left_semi")
        self.counts = shared_table(self.counts.join(touched, ["k1", "k2"], "left_anti").unionByName(now), "line-counts")
        if self.counts.count() > 2 * self.shards * SHARD_KEYS:
            self._build_filters()
            return
        changes = now.select("k1", "k2", F.lit(1).alias("now")).join(was.select("k1", "k2", F.lit(1).alias("was")), ["k1", "k2"], "full").select(
            self._shard(), "k1", (F.coalesce("now", F.lit(0)) - F.coalesce("was", F.lit(0))).alias("change")
        )
        old = self.filters.select("shard", F.lit(0).cast("long").alias("k1"), F.lit(0).alias("change"), "filter")
        both = changes.where("change <> 0").withColumn("filter", F.lit(None).cast("binary")).unionByName(old)
        filters = shared_table(both.groupBy("shard").applyInArrow(_change, "shard int, filter binary"), "filters")
        full = self.counts.select(self._shard(), "k1").join(filters.where("filter is null").select("shard"), "shard", "left_semi")
        built = full.groupBy("shard").applyInArrow(_build, "shard int, filter binary")
        self.filters = shared_table(filters.where("filter is not null").unionByName(built), "filters")

    def _build_filters(self) -> None:
        self.shards = max(1, -(-self.counts.count() // SHARD_KEYS))
        self.filters = shared_table(self.counts.select(self._shard(), "k1").groupBy("shard").applyInArrow(_build, "shard int, filter binary"), "filters")

    def _shard(self):
        return F.pmod(F.xxhash64("k1"), F.lit(self.shards)).cast("int").alias("shard")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """Add the lines of documents; an id that is there already may gain lines by it."""
        self._change(docs, 1, id_col, text_col)
        return self

    def delete(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """Take away the lines of documents, given by ids and texts; lines that an id doesn't hold are passed over."""
        self._change(docs, -1, id_col, text_col)
        return self

    def dropped(self) -> DataFrame:
        """(id, keys): for each document the keys (16 bytes each, joined) whose lines it loses."""
        live = self.rows if self.generations == 1 else self._live(self.rows)
        salts = shuffle_partitions(self.spark)
        lines = live.select(self._shard(), F.pmod(F.xxhash64("id", "k2"), F.lit(salts)).cast("int").alias("salt"), "id", "k1", "k2")
        kind = lines.schema["id"].dataType
        heads = self.filters.select(
            "shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(None).cast(kind).alias("id"),
            F.lit(None).cast("long").alias("k1"), F.lit(None).cast("long").alias("k2"), "filter",
        )
        routed = lines.withColumn("filter", F.lit(None).cast("binary")).unionByName(heads).repartition(salts, "shard", "salt")
        routed = routed.sortWithinPartitions("shard", "salt", F.col("filter").isNull())
        likely = routed.mapInArrow(_probe, f"id {kind.simpleString()}, k1 long, k2 long")
        lost = likely.join(self.counts, ["k1", "k2"]).where(~F.col("id").eqNullSafe(F.col("last")))
        key = F.struct("k1", "k2")
        return lost.groupBy("id").agg(F.collect_list(key).alias("keys"))

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``doc_id, n_lines, n_dropped, kept`` for documents of the index; ``kept`` is the text that stays."""
        kind = id_type(docs, id_col)
        rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        lost = shared_table(self.dropped().withColumnRenamed("id", "_id"), "lost")
        # Only texts that may lose lines are moved to meet their keys.
        moved, still = split_by_bitmap(rows, F.col("id"), shared_table(bitmap(lost, F.col("_id")), "losers"))
        both = moved.join(lost, F.col("id").eqNullSafe(F.col("_id")), "left").select("id", "text", "keys")
        cut = [
            map_texts(
                x, _cut(self.min_chars), f"id {kind}, n_lines long, n_dropped long, kept string, kept_sha256 string", "id", "text", {"keys": F.col("keys")}
            )
            for x in (both, still.withColumn("keys", F.lit(None).cast(lost.schema["keys"].dataType)))
        ]
        return cut[0].unionAll(cut[1]).withColumnRenamed("id", "doc_id")


def _cut(least: int):
    def run(docs) -> Iterator[dict]:
        for ids, texts, batch in docs:
            total, dropped, kept, digests = [], [], [], []
            for text, keys in zip(texts, batch.column("keys").to_pylist(), strict=True):
                lines = text.encode("utf-8", "surrogatepass").split(b"\n")
                total.append(len(lines))
                if keys:
                    gone = {np.array([k["k1"], k["k2"]], np.int64).tobytes() for k in keys}
                    stay = [x for x, k in zip(lines, _keys(text, least), strict=True) if k not in gone]
                else:
                    stay = lines
                dropped.append(len(lines) - len(stay))
                left = b"\n".join(stay)
                kept.append(left.decode("utf-8", "surrogatepass"))
                digests.append(hashlib.sha256(left).hexdigest())
            yield {"id": ids, "n_lines": total, "n_dropped": dropped, "kept": kept, "kept_sha256": digests}

    return run


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_lines, n_dropped, kept, kept_sha256``.

    Texts are split at ``\\n``; a null or empty text is one empty line.  A line's key is the line without ``[\\x20\\x09-\\x0D]``
    at its ends, A-Z lower-cased.  Keys of ``min_chars`` code points or more that ``min_docs`` documents or more hold lose
    all their lines except in the largest id that holds them.  Rows that repeat an id are one document; a null id is a
    document below all others.  An empty table gives an empty result.
    """
    return LineIndex(docs.sparkSession, min_chars, min_docs).insert(docs, id_col, text_col).apply(docs, id_col, text_col)
