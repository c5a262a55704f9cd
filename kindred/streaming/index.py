"""A stored index of signatures as generations of Parquet, with atomic commits, removals, compaction and streaming ingest."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ClosedIndexError, CompatibilityError, ConfigurationError, DuplicateKeyError, ProgressCancelledError, StorageError
from ..functions.features import WordShingles
from ..operators import lsh, minhash
from ..operators.dedupe import Settings
from ..operators.tables import scratch, shared_table
from ..plans import planner
from . import lookup, ranges
from .storage import HadoopStorage, Storage

#: Generations and share of removed keys beyond which a commit merges the generations.
MOST_GENERATIONS, MOST_REMOVED = 32, 0.25

ROWS = "key bigint, signature array<bigint>, buckets array<bigint>, removed boolean"
_LENGTH = "a signature has another length than the index"


@dataclass(frozen=True)
class ProgressEvent:
    """What a batch that was committed makes known."""

    completed: int
    total: int
    batch_size: int
    elapsed_seconds: float
    items_per_second: float
    final: bool


class StoredIndex:
    """Signatures by key in a folder.

    ``meta-<version>.json`` names the generations; it is written last and never changed, so a reader keeps its version and
    a commit that was interrupted is not seen.  Each generation holds rows ``key, signature, buckets, removed``; for a key the
    highest generation counts.  ``buckets`` are the band hashes, so that nothing is banded again; an index without signatures
    has null signatures and can't score.  Merged rows lie in a folder for each range of keys, sorted, and a later merge writes the
    ranges that changed and links the others (``ranges``).  Paths are reached through Spark's
    file systems only; of two writers of one version the file system's exclusive creation lets one win, so a store
    without that needs a single writer or a ``storage`` of its own (see ``storage.conformance``).
    """

    def __init__(self, spark: SparkSession, path: str, meta: dict, read_only: bool, storage: Storage | None = None) -> None:
        self.spark, self.path, self.meta, self.read_only, self._closed = spark, path.rstrip("/"), meta, read_only, False
        self.storage = storage or HadoopStorage(spark)
        self._tables: dict[str, tuple[DataFrame, str]] = {}
        self._noted: dict = {}

    # --- files -------------------------------------------------------------------------------------------------------

    @staticmethod
    def _versions(storage: Storage, path: str) -> list[int]:
        return sorted(int(n[5:-5]) for n in storage.names(path) if n.startswith("meta-") and n.endswith(".json"))

    @classmethod
    def create(cls, spark: SparkSession, path: str, settings: Settings | None = None, storage: Storage | None = None, lookups: bool = False) -> StoredIndex:
        """A new index; a path that is in use is refused.  With ``lookups`` each generation also has its buckets' members in
        files by bucket (``lookup``), so that a search doesn't move the index; a ``GroupedIndex`` always has them."""
        s = settings or Settings()
        storage = storage or HadoopStorage(spark)
        if storage.exists(path):
            raise StorageError(f"{path} exists")
        bands, rows = s.bands
        meta = {"version": 0, "threshold": s.threshold, "num_perm": s.num_perm, "seed": s.seed, "width": s.width, "bands": bands, "rows": rows, "stores_signatures": s.store_signatures, "generations": []}
        if lookups or cls is not StoredIndex:
            meta["lookups"] = {}
        out = cls(spark, path, meta, False, storage)
        out._publish(meta)
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str, read_only: bool = False, version: int | None = None, storage: Storage | None = None) -> StoredIndex:
        """The newest version, or an older one to read."""
        storage = storage or HadoopStorage(spark)
        versions = cls._versions(storage, path)
        if not versions or (version is not None and version not in versions):
            raise StorageError(f"no index version at {path}")
        at = versions[-1] if version is None else version
        return cls(spark, path, json.loads(storage.read(f"{path}/meta-{at}.json")), read_only or version is not None, storage)

    def _publish(self, meta: dict) -> None:
        """Commit: the file of the next version is created if no other writer did so first."""
        self.storage.create(f"{self.path}/meta-{meta['version']}.json", json.dumps(meta, sort_keys=True))
        self.meta = meta

    def _staged(self, rows: DataFrame, layout: list[tuple[int, str | None]] | None = None) -> str:
        """Write rows as a generation that no version names yet; with a layout, as those of its ranges that have no folder."""
        if self.read_only:
            raise StorageError("the index is open to read only")
        name = f"gen-{uuid.uuid4().hex}"
        try:
            rows = rows.select("key", "signature", "buckets", "removed")
            if layout is None:
                rows.write.parquet(f"{self.path}/{name}")
            else:
                ranges.write(rows, f"{self.path}/{name}", layout)
                linked = ranges.linked(layout, name, set(self.storage.names(f"{self.path}/{name}")))
                self.meta = self.meta | {"pieces": self.meta.get("pieces", {}) | {name: linked}}
            if "lookups" in self.meta:
                here = self._generation(name).where("not removed")
                files = lookup.file_count(here.count() * self.meta["bands"])
                lookup.write(lsh.stored_bands(here, "key"), f"{self.path}/look-{name[4:]}", files)
                self.meta = self.meta | {"lookups": self.meta["lookups"] | {name: files}}
        except Exception:
            self._discard(name)
            raise
        return name

    def _discard(self, name: str) -> None:
        self.storage.delete(f"{self.path}/{name}")
        if name in self.meta.get("pieces", {}):
            self.meta = self.meta | {"pieces": {k: p for k, p in self.meta["pieces"].items() if k != name}}
        if name.startswith("gen-"):
            self.storage.delete(f"{self.path}/man-{name[4:]}")
        if name.startswith("gen-") and "lookups" in self.meta:
            self.storage.delete(f"{self.path}/look-{name[4:]}")
            self.meta = self.meta | {"lookups": {k: n for k, n in self.meta["lookups"].items() if k != name}}

    def _commit(self, name: str, instead: bool = False) -> None:
        generations = [name] if instead else [*self.meta["generations"], name]
        held = {"lookups": {k: n for k, n in self.meta["lookups"].items() if k in generations}} if "lookups" in self.meta else {}
        if "pieces" in self.meta:
            held["pieces"] = {k: p for k, p in self.meta["pieces"].items() if k in generations}
        written = {f.split("/")[0][4:] for g in generations for f in [g, *self._folders(g)]}
        held["manifests"] = [m for m in self.meta.get("manifests", []) if m[4:] in written]
        try:
            held["manifests"].append(self._manifest(name))
            self._publish(self.meta | {"version": self.meta["version"] + 1, "generations": generations} | held | self._noted)
        except StorageError:
            self._discard(name)
            raise

    # --- files of a commit ----------------------------------------------------------------------------------------------

    def _bytes_of(self, name: str) -> DataFrame:
        """``file, length, crc`` of the part files of a generation and of its lookup, from their stored bytes, in executors."""
        folders = [name, *([f"look-{name[4:]}"] if name in self.meta.get("lookups", {}) else [])]
        folders = [f for f in folders if self.storage.exists(f"{self.path}/{f}")]
        if not folders:
            return self.spark.createDataFrame([], "file string, length bigint, crc bigint")
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True)
        file = F.regexp_extract("path", "((gen|look)-[0-9a-f]{32}/.*)$", 1)
        return files.load([f"{self.path}/{f}" for f in folders]).select(file.alias("file"), "length", F.crc32("content").alias("crc"))

    def _in_use(self, files: DataFrame, name: str) -> DataFrame:
        """Those of a generation's files (``file``) that this version reads: a merge may have replaced ranges, or the lookup."""
        ranged = F.regexp_extract("file", "^(gen-[^/]*/range=[^/]*)/", 1)
        used = (ranged == "") | ranged.isin([f for g in self.meta["generations"] for f in self._folders(g) if f.startswith(f"{name}/")])
        return files.where(used if name in self.meta.get("lookups", {}) else used & ~F.startswith("file", F.lit("look-")))

    def _manifest(self, name: str) -> str:
        """Write what a generation's files must be, as a table that the commit names."""
        manifest = f"man-{name[4:]}"
        self._bytes_of(name).write.mode("overwrite").parquet(f"{self.path}/{manifest}")
        return manifest

    def verify_files(self) -> DataFrame:
        """``file, problem`` of part files that aren't as their commit left them: ``lost``, ``length``, ``checksum`` or ``unknown``.

        Each file is read once, in an executor, and held there as a whole; generations of before there were manifests are passed over."""
        self._check()
        out = self.spark.createDataFrame([], "file string, problem string")
        for manifest in self.meta.get("manifests", []):
            name = f"gen-{manifest[4:]}"
            want = self._in_use(self.spark.read.schema("file string, length bigint, crc bigint").parquet(f"{self.path}/{manifest}"), name)
            now = self._in_use(self._bytes_of(name), name).select("file", F.col("length").alias("l"), F.col("crc").alias("c"))
            problem = F.when(F.col("c").isNull(), "lost").when(F.col("crc").isNull(), "unknown").when(F.col("l") != F.col("length"), "length").when(F.col("c") != F.col("crc"), "checksum")
            out = out.unionAll(want.join(now, "file", "full").select("file", problem.alias("problem")).where("problem is not null"))
        return out

    # --- contents ----------------------------------------------------------------------------------------------------

    def _check(self) -> None:
        if self._closed:
            raise ClosedIndexError("the index is closed")

    def _folders(self, name: str) -> list[str]:
        """Where a generation's rows lie: in its own folder, or in those of ranges, some of which earlier merges wrote."""
        pieces = self.meta.get("pieces", {}).get(name)
        return [name] if pieces is None else [folder for _, folder in pieces]

    def _rows_in(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], ROWS)
        return self.spark.read.schema(ROWS).parquet(*[f"{self.path}/{f}" for f in folders])

    def _generation(self, name: str) -> DataFrame:
        return self._rows_in(self._folders(name))

    def history(self) -> DataFrame:
        """``key, signature, buckets, removed, gen`` of all generations."""
        self._check()
        out = self.spark.createDataFrame([], f"{ROWS}, gen int")
        for i, name in enumerate(self.meta["generations"]):
            out = out.unionByName(self._generation(name).withColumn("gen", F.lit(i)))
        return out

    def live(self) -> DataFrame:
        """``key, signature, buckets`` of the keys that are in the index.  One generation is read as it is."""
        names = self.meta["generations"]
        if len(names) == 1:
            self._check()
            return self._generation(names[0]).where("not removed").select("key", "signature", "buckets")
        last = self.history().groupBy("key").agg(F.max_by(F.struct("signature", "buckets", "removed"), "gen").alias("x"))
        return last.where(~F.col("x.removed")).select("key", "x.signature", "x.buckets")

    def live_keys(self) -> DataFrame:
        """``key`` alone: signatures and buckets are not read."""
        last = self.history().select("key", "removed", "gen").groupBy("key").agg(F.max_by("removed", "gen").alias("removed"))
        return last.where("not removed").select("key")

    def bands(self) -> DataFrame:
        """``key, band, bucket`` as they are stored."""
        return lsh.stored_bands(self.live().select("key", "buckets"), "key")

    def _members(self, asked: DataFrame) -> DataFrame:
        """``query, key``, repeated or not: the keys in the index that share a bucket with each of ``query, band, bucket``.

        With lookups, each generation's files of the buckets asked for are read where they lie, and members that a later generation
        removed are left out; else the live rows are banded and exchanged."""
        self._check()
        if "lookups" not in self.meta:
            return lsh.query(self.bands(), asked.withColumnRenamed("query", "key"))
        few = lookup.few_buckets(asked)
        found = self.spark.createDataFrame([], f"query {asked.schema['query'].dataType.simpleString()}, key bigint, at int")
        gone = self.spark.createDataFrame([], "key bigint, since int")
        for i, name in enumerate(self.meta["generations"]):
            if name not in self._tables:
                self._tables[name] = lookup.read(self.spark, f"{self.path}/look-{name[4:]}", self.meta["lookups"][name])
            found = found.unionByName(lookup.members(self._tables[name][0], asked, few).select("query", "key", F.lit(i).alias("at")))
            gone = gone.unionByName(self._generation(name).where("removed").select("key", F.lit(i).alias("since")))
        gone = gone.groupBy("key").agg(F.max("since").alias("since")).withColumnRenamed("key", "_gone")
        return found.join(gone, (F.col("key") == F.col("_gone")) & (F.col("since") > F.col("at")), "left_anti").select("query", "key")

    def _rows_of(self, keys: DataFrame) -> DataFrame:
        """``key, buckets`` of some keys (``key``, distinct)."""
        last = self.history().select("key", "buckets", "removed", "gen").join(keys, "key", "left_semi")
        last = last.groupBy("key").agg(F.max_by(F.struct("buckets", "removed"), "gen").alias("x"))
        return last.where(~F.col("x.removed")).select("key", "x.buckets")

    def signature(self, key: int) -> list[int] | None:
        """The stored signature of a key; None if it isn't there or the index stores none."""
        row = self.live().where(F.col("key") == key).select("signature").first()
        return None if row is None else row.signature

    @property
    def stores_signatures(self) -> bool:
        return self.meta.get("stores_signatures", True)

    @property
    def _law(self) -> tuple[int, int, int]:
        m = self.meta
        return m["num_perm"], m["seed"], m["width"]

    def insert(self, records: DataFrame, key: str, features: Column | WordShingles) -> StoredIndex:
        """Add a batch: all of it, or none if a key repeats or is in the index."""
        self._check()
        return self.insert_signatures(minhash.sign(records, key, features, *self._law).withColumnRenamed(key, "key"), self._law)

    def insert_signatures(self, rows: DataFrame, law: tuple[int, int, int]) -> StoredIndex:
        """Add rows ``key, signature`` made with (num_perm, seed, width).

        The batch is written once; the checks read what was written, and a batch that fails one is deleted again."""
        self._check()
        minhash.check_compatible(law, self._law)
        m = self.meta
        right = F.size("signature") == m["num_perm"]
        checked = F.when(right, F.col("signature")).otherwise(F.raise_error(F.lit(_LENGTH)).cast("array<bigint>"))
        rows = rows.select(F.col("key").cast("bigint").alias("key"), checked.alias("signature"))
        rows = rows.withColumn("buckets", lsh.band_hashes(m["bands"], m["rows"]))
        if not self.stores_signatures:
            rows = rows.withColumn("signature", F.lit(None).cast("array<bigint>"))
        try:
            name = self._staged(rows.withColumn("removed", F.lit(False)))
        except Exception as e:
            if _LENGTH in str(e):
                raise CompatibilityError(_LENGTH) from e
            raise
        new = self._generation(name).select("key")
        twice = new.groupBy("key").count().where("count > 1").select("key")
        held = new.join(self.live_keys(), "key", "left_semi")
        bad = twice.unionAll(held).limit(1).collect()
        if bad:
            self._discard(name)
            raise DuplicateKeyError(f"key {bad[0].key} is in the batch twice or in the index")
        self._commit(name)
        return self._tidy()

    def insert_in_batches(
        self, records: DataFrame, key: str, features: Column, batches: int, progress: Callable[[ProgressEvent], bool | None] | None = None
    ) -> StoredIndex:
        """Add records in ``batches`` commits, dealt out by a hash of their keys.  ``progress`` hears of each; if it returns False, what
        was committed stays and a ProgressCancelledError tells how many records that are."""
        if isinstance(batches, bool) or batches < 1:
            raise ConfigurationError("batches must be positive")
        began, done, total = time.monotonic(), 0, records.count()
        for i in range(batches):
            part = records.where(F.pmod(F.xxhash64(key), F.lit(batches)) == i)
            n = part.count()
            if n:
                self.insert(part, key, features)
            done += n
            took = time.monotonic() - began
            if progress is not None and n:
                if progress(ProgressEvent(done, total, n, took, done / took if took else 0.0, done == total)) is False:
                    raise ProgressCancelledError(done)
        return self

    def remove(self, keys: DataFrame, key: str) -> int:
        """Remove keys; the number of those that were there."""
        self._check()
        gone = keys.select(F.col(key).cast("bigint").alias("key")).distinct().join(self.live_keys(), "key", "left_semi")
        none = F.lit(None).cast("array<bigint>")
        name = self._staged(gone.select("key", none.alias("signature"), none.alias("buckets"), F.lit(True).alias("removed")))
        n = self._generation(name).count()
        if not n:
            self._discard(name)
            return 0
        self._commit(name)
        self._tidy()
        return n

    def _tidy(self) -> StoredIndex:
        counts = self.history().select("removed").agg(F.count("*").alias("n"), F.count(F.when(F.col("removed"), 1)).alias("gone")).first()
        if len(self.meta["generations"]) > MOST_GENERATIONS or counts.gone > MOST_REMOVED * max(1, counts.n):
            self.merge()
        return self

    def compact(self, range_rows: int = ranges.RANGE_ROWS) -> StoredIndex:
        """Fold all generations into one without removed keys, written anew in ranges of about ``range_rows`` keys, sorted by key."""
        self._check()
        layout = ranges.arrange(self.live_keys(), [], [0], range_rows)
        self._commit(self._staged(self.live().withColumn("removed", F.lit(False)), layout), instead=True)
        return self

    def merge(self, range_rows: int = ranges.RANGE_ROWS) -> int:
        """Fold the later generations into the first; the number of ranges of keys that were read and written for it.

        Only ranges in which a later generation has keys are read and written; the new version links the folders of the others,
        so what is written follows the change where keys that change lie together (those given in order of arrival do; keys spread over
        all ranges change all).  Older versions keep their folders until ``vacuum``.  A first generation that isn't in ranges is compacted.
        Lookups are by bucket, not by key: an index that has them writes these (keys and buckets, no signatures) in full."""
        self._check()
        names = self.meta["generations"]
        if not names or names[0] not in self.meta.get("pieces", {}):
            self.compact(range_rows)
            return len(self._folders(self.meta["generations"][0]))
        if len(names) == 1:
            return 0
        pieces = [(low, folder) for low, folder in self.meta["pieces"][names[0]]]
        with scratch():
            later = self.history().where("gen > 0").groupBy("key").agg(F.max_by(F.struct("signature", "buckets", "removed"), "gen").alias("x"))
            later = shared_table(later.select("key", "x.*"), "later")
            touched = ranges.touched(later, pieces)
            old = self._rows_in([pieces[i][1] for i in touched if pieces]).join(later.select("key"), "key", "left_anti")
            now = old.unionByName(later.where("not removed"))
            layout = ranges.arrange(now.select("key"), pieces, touched, range_rows)
            self._commit(self._staged(now, layout), instead=True)
        return sum(folder is None for _, folder in layout)

    def vacuum(self, keep_versions: int = 1) -> int:
        """Delete all but the newest versions, and the generations and ranges that none of those names; the number of generations deleted.

        Readers of a deleted version fail, and a batch that another writer has staged is lost to it."""
        self._check()
        if self.read_only or keep_versions < 1:
            raise StorageError("an index that is open to read only keeps its versions, and every index keeps one")
        versions = self._versions(self.storage, self.path)
        kept = versions[-keep_versions:]
        metas = [self.open(self.spark, self.path, version=v, storage=self.storage).meta for v in kept]
        linked = {folder for m in metas for pieces in m.get("pieces", {}).values() for _, folder in pieces}
        holders = {f.split("/")[0] for f in linked}
        manifests = {n for m in metas for n in m.get("manifests", [])}
        named = holders | manifests | {n for m in metas for n in [*m["generations"], *m.get("labels", []), *(f"look-{x[4:]}" for x in m.get("lookups", {}))]}
        gone = [n for n in self.storage.names(self.path) if n.startswith(("gen-", "labels-", "look-", "man-")) and n not in named]
        for version in versions[:-keep_versions]:
            self._discard(f"meta-{version}.json")
        for name in gone:
            self.storage.delete(f"{self.path}/{name}")
        for holder in holders:
            for n in self.storage.names(f"{self.path}/{holder}"):
                if n.startswith("range=") and f"{holder}/{n}" not in linked:
                    self.storage.delete(f"{self.path}/{holder}/{n}")
        return sum(n.startswith("gen-") for n in gone)

    def expired(self, seconds: int, now: float | None = None) -> bool:
        """Whether the last commit is longer ago than a retention of whole seconds; every commit begins it anew."""
        if isinstance(seconds, bool) or not isinstance(seconds, int) or seconds < 1:
            raise ConfigurationError("a retention is a positive number of whole seconds")
        return (time.time() if now is None else now) - self.storage.modified(f"{self.path}/meta-{self.meta['version']}.json") > seconds

    def drop(self) -> None:
        """Delete the index and close it."""
        self._check()
        if self.read_only:
            raise StorageError("the index is open to read only")
        self.storage.delete(self.path)
        self.close()

    def contains(self, keys: DataFrame, key: str) -> DataFrame:
        """``key, present`` for each distinct key asked for."""
        asked = keys.select(F.col(key).cast("bigint").alias("key")).distinct()
        return asked.join(self.live_keys().withColumn("p", F.lit(True)), "key", "left").select("key", F.coalesce("p", F.lit(False)).alias("present"))

    def search(self, queries: DataFrame, key: str, features: Column, min_similarity: float | None = None, top_k: int | None = None) -> DataFrame:
        """``query, key`` of candidates; with a bound or a limit also ``similarity`` (and ``rank``)."""
        self._check()
        return self.search_signatures(minhash.sign(queries, key, features, *self._law), key, min_similarity, top_k)

    def search_signatures(self, signed: DataFrame, key: str, min_similarity: float | None = None, top_k: int | None = None) -> DataFrame:
        """The same for rows ``<key>, signature`` that are made as those of the index."""
        self._check()
        scores = min_similarity is not None or top_k is not None
        if scores and not self.stores_signatures:
            raise ConfigurationError("the index does not store signatures, so it can't score")
        m = self.meta
        signed = shared_table(signed.select(F.col(key).alias("key"), "signature", lsh.band_hashes(m["bands"], m["rows"]).alias("buckets")), "queries")
        if not scores and "lookups" in m:
            return self._members(lsh.stored_bands(signed, "key").withColumnRenamed("key", "query")).distinct()
        by = "signature" if scores else "buckets"
        own, asked = (shared_table(lsh.alike(lsh.marked(rows, by), "mark"), "alike") for rows in (self.live(), signed))
        heads, asking = own.where("key = head"), asked.where("key = head")
        if "lookups" in m:
            met = self._members(lsh.stored_bands(asking, "key").withColumnRenamed("key", "query"))
            found = met.join(heads.select("key"), "key", "left_semi").distinct()
        else:
            found = lsh.query(lsh.stored_bands(heads, "key"), lsh.stored_bands(asking, "key"))
        if not scores:
            return lsh.expand_found(found, asked, own)
        # Heads of classes of equal signatures are scored: their members have the same similarity.
        scored = lsh.score(found, "query", "key", asking, "key", heads, "key")
        if min_similarity is not None:
            scored = lsh.at_least(scored, min_similarity)
        return lsh.expand_found(scored, asked, own) if top_k is None else lsh.top_of_classes(scored, asked, own, top_k)

    def stats(self) -> DataFrame:
        """The distribution of bucket sizes, with the version, generations, live keys and stored bytes."""
        size = sum(self.storage.size(f"{self.path}/{n}") for g in self.meta["generations"] for n in self._folders(g))
        return lsh.bucket_distribution(self.bands()).withColumns({
            "version": F.lit(self.meta["version"]), "generations": F.lit(len(self.meta["generations"])),
            "keys": F.lit(len(self)).cast("bigint"), "bytes": F.lit(size).cast("bigint"),
        })

    def explain(self, items: int | None = None, budget: int | None = None, mode: str = "auto") -> DataFrame:
        """The planner's report on this index, for as many keys as it has or ``items``."""
        m = self.meta
        report = planner.plan(max(1, len(self)) if items is None else items, m["threshold"], m["num_perm"], budget, mode, m["width"], (m["bands"], m["rows"]))
        return planner.plan_frame(self.spark, [report])

    def verify(self) -> DataFrame:
        """``problem, n``: keys that repeat in a generation, removals of absent keys, signatures of a wrong length, buckets that
        aren't those of the signature, generations whose files are gone."""
        names = self.meta["generations"]
        held = {h: set(self.storage.names(f"{self.path}/{h}")) for h in {f.split("/")[0] for n in names for f in [n, *self._folders(n)]}}
        whole = lambda folder: "_SUCCESS" in held[folder.split("/")[0]] and ("/" not in folder or folder.split("/")[1] in held[folder.split("/")[0]])
        there = [n for n in names if all(whole(f) for f in [n, *self._folders(n)])]
        if len(there) < len(names):
            return self.spark.createDataFrame([("missing_generations", len(names) - len(there))], "problem string, n bigint")
        rows = self.history()
        m = self.meta
        repeated = rows.groupBy("gen", "key").count().where("count > 1")
        kept = rows.where("not removed")
        wrong = kept.where((F.size("signature") != m["num_perm"]) if self.stores_signatures else F.col("signature").isNotNull())
        other = lsh.band_hashes(m["bands"], m["rows"]) if self.stores_signatures else F.col("buckets")
        strange = kept.where(~(F.col("buckets").eqNullSafe(other)) | (F.size("buckets") != m["bands"]))
        before = rows.select("key", F.col("gen").alias("g0"), F.col("removed").alias("r0"))
        orphans = rows.where("removed").join(before.where("not r0"), "key", "left").groupBy("key", "gen").agg(F.min("g0").alias("g0")).where("g0 is null or g0 >= gen")
        each = [("repeated_keys", repeated), ("wrong_lengths", wrong), ("wrong_buckets", strange), ("orphan_removals", orphans)]
        out = None
        for name, df in each:
            row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
            out = row if out is None else out.unionAll(row)
        return out

    def __len__(self) -> int:
        return self.live_keys().count()

    def close(self) -> None:
        for _, table in self._tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._tables, self._closed = {}, True

    @property
    def closed(self) -> bool:
        return self._closed

    def __enter__(self) -> StoredIndex:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # --- streams -----------------------------------------------------------------------------------------------------

    def append(self, records: DataFrame, features: Column, order: list[Column], batch: tuple[str, int] | None = None) -> tuple[int, int]:
        """Add records under keys of the index's own, dense and in order of ingestion; the range [first, end) that they got.

        Keys go on where the last commit that reserved some ended, in ``order`` within the batch (rows that agree in it, in any); the
        commit records the range.  ``batch``, a stream's name and the batch's number, is recorded with it: a batch whose
        number isn't beyond the last one of its stream is a replay, which gets an empty range and reads no index data."""
        self._check()
        first = self.meta.get("next_key", 0)
        if batch is not None and batch[1] <= self.meta.get("batches", {}).get(batch[0], -1):
            return first, first
        with scratch():
            rows = records.select(features.alias("_features"), *[c.alias(f"_o{i}") for i, c in enumerate(order)])
            by = [F.col(f"_o{i}") for i in range(len(order))]
            ranged = shared_table(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()), "ordered")
            parts = ranged.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()  # one row for each task that sorted
            starts, end = {}, first
            for r in parts:
                starts[r["_part"]], end = end, end + r.n
            if not parts:
                return first, first
            start = self.spark.createDataFrame(list(starts.items()), "_part int, _start bigint")
            within = F.row_number().over(Window.partitionBy("_part").orderBy(*by)) - 1
            keyed = ranged.withColumn("_within", within).join(F.broadcast(start), "_part").select((F.col("_start") + F.col("_within")).alias("key"), "_features")
            self._noted = {"next_key": end} | self._with_batch(batch)
            try:
                self.insert(keyed, "key", F.col("_features"))
            finally:
                self._noted = {}
        return first, end

    def _with_batch(self, batch: tuple[str, int] | None) -> dict:
        return {} if batch is None else {"batches": self.meta.get("batches", {}) | {batch[0]: batch[1]}}

    def ingest(
        self, stream: DataFrame, key: str | None, features: Column | WordShingles, checkpoint: str, progress: Callable[[int], bool | None] | None = None,
        order: list[Column] | None = None, name: str | None = None,
    ):
        """Start a stream that adds each micro-batch as a generation of its own.

        The commit records the stream's ``name`` (its checkpoint if none is given) and the batch's number, so that a batch that is given
        again after a failure is recognised from the log alone.  Without ``key``, keys are dense, in ``order`` within a batch (``append``).
        With one, keys that are there already are passed over, as are rows that repeat a key in a batch, but for one.
        ``progress`` gets the number of keys so far; False stops the stream after the batch that was committed."""
        own = name or checkpoint

        def add(batch: DataFrame, number: int) -> None:
            if number <= self.meta.get("batches", {}).get(own, -1):
                return
            if key is None:
                made = features.column if isinstance(features, WordShingles) else features
                self.append(batch, made, order or [made], (own, number))
            else:
                self._noted = self._with_batch((own, number))
                try:
                    add_new(batch)
                finally:
                    self._noted = {}
            if progress is not None and progress(len(self)) is False:
                raise ProgressCancelledError(len(self))

        def add_new(batch: DataFrame) -> None:
            # Signed where they lie: signatures are exchanged, not records.
            self._check()
            signed = minhash.sign(batch, key, features, *self._law).withColumnRenamed(key, "key")
            self.insert_signatures(signed.dropDuplicates(["key"]).join(self.live_keys(), "key", "left_anti"), self._law)

        return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
