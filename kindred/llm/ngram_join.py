"""Parity-sketch similarity join on word shingles: XOR sketches, pigeonhole per size band, Hamming bound, exact check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tables import free_shuffles, scratch
from .bitmaps import bitmap, in_bitmap, split_by_bitmap, unused
from .common import components, gram_hashes, hash_words, id_type, map_texts, mix, shared_table, shuffle_partitions, small_batches, space_words, with_group

#: Rows of one bucket that a task compares with as many others at a time.
BLOCK_ROWS = 512


#: The low bits of a token hold its band.
BAND_MASK = 63

#: Pairs, each with two sets, that go to a Python worker at a time, and bytes of them.
PAIR_ROWS, PAIR_BYTES = 500, 4 << 20

#: Classes that a task remembers, so as not to give the sketch of a repeated set again.
SEEN = 200_000

#: Bytes of a table that a task reads at a time where each of its rows becomes very many.
SPLIT_BYTES = 2 << 20

#: How tables between steps are written: in small row groups, as a task holds one as a whole.
TABLE = {"parquet.block.size": SPLIT_BYTES}


class Bands:
    """Size bands and what the threshold means for set sizes.

    Sets link when ``100 * intersection >= percent * union``.  Then their sizes differ by at most that ratio and their
    symmetric difference is at most ``(a + b) * (100 - percent) / (100 + percent)``, which is what ``most`` gives.
    """

    def __init__(self, percent: int) -> None:
        if not 70 <= percent <= 100:
            raise ValueError("percent must be within 70 and 100: below, too many sets fill too few blocks of a sketch")
        self.percent = percent

    def of(self, n: int) -> int:
        return n.bit_length() - 1

    def high(self, band: int) -> int:
        return (2 << band) - 1

    def most(self, total: int) -> int:
        return total * (100 - self.percent) // (100 + self.percent)

    def blocks(self, band: int) -> int:
        """XOR blocks of a sketch in this band: over the largest possible difference, with room for empty blocks."""
        return (self.most(2 * self.high(band)) + 1) * 27 // 20 + 4

    def bits(self, band: int) -> int:
        """Bits of the parity sketch: about 24 for each differing shingle that is allowed, so that few of them cancel."""
        return 64 * (self.most(2 * self.high(band)) * 3 // 8 + 1)

    def joined(self, n: int) -> list[tuple[int, int]]:
        """(band, largest size of a partner there) of a set of n: its own band, and each later one a partner can be in.

        A pair meets in the band of its larger set."""
        own, top = self.of(n), n * 100 // self.percent
        return [(b, min(top, self.high(b))) for b in range(own, self.of(top) + 1)]


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; a text of fewer words is one shingle; no words, none."""
    words = hash_words(space_words(text))
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(words, min(k, len(words))) + np.uint64(min(k, len(words))))


def set_key(s: np.ndarray) -> bytes:
    """128 bits that stand for a set of hashes."""
    if not len(s):
        return bytes(16)
    with np.errstate(over="ignore"):
        return np.array([np.bitwise_xor.reduce(mix(s + np.uint64(11))), np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)))]).tobytes()


def short_key(key: bytes) -> int:
    return int.from_bytes(key[:8], "big", signed=True)


def sketch(s: np.ndarray, band: int, top: int, bands: Bands) -> tuple[np.ndarray, bytes]:
    """(tokens, parity bits) of a set in a band.

    Each shingle XORs its hash into one block.  A shingle in which two sets differ changes one block at most, so of m
    blocks at least m - difference agree.  At most z of those are empty on both sides, z being the number of a set's own
    empty blocks, so of its filled blocks all but ``difference`` agree: the first ``difference + 1`` filled blocks of
    either set, in block order, share one (prefix form of the pigeonhole principle).  They are the tokens.  A set
    with fewer filled blocks gives all, and a token that all such sets of the band share.
    """
    m, need = bands.blocks(band), bands.most(len(s) + top) + 1
    h = mix(s + np.uint64(band))
    block = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    order = np.argsort(block, kind="stable")
    block, at = block[order], h[order]
    starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    with np.errstate(over="ignore"):
        tokens = mix(np.bitwise_xor.reduceat(at, starts) + mix(block[starts] * np.uint64(64) + np.uint64(band)))
    filled = len(tokens)
    tokens = tokens[:need]
    if filled < need:
        tokens = np.append(tokens, mix(np.array([band + (1 << 40)], np.uint64)))
    tokens = (tokens & ~np.uint64(BAND_MASK)) | np.uint64(band)
    bits = bands.bits(band)
    where = (((h & np.uint64(0xFFFFFFFF)) * np.uint64(bits)) >> np.uint64(32)).astype(np.int64)
    return tokens, np.packbits((np.bincount(where, minlength=bits) & 1).astype(np.uint8)).tobytes()


SKETCHES = pa.list_(pa.struct([("band", pa.int32()), ("bits", pa.binary()), ("tokens", pa.list_(pa.int64()))]))


def _sketch_docs(k: int, percent: int):
    """Set size and key of each document, and the sketches of the first document of a class that this task meets."""
    bands = Bands(percent)

    def run(docs) -> Iterator[dict]:
        seen: set[bytes] = set()
        for ids, texts, part in docs:
            n, keys, sketches = [], [], []
            for text in texts:
                s = shingle_set(text, k)
                key = set_key(s)
                n.append(len(s))
                keys.append(key)
                if not len(s) or key in seen:
                    sketches.append(None)
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                own = []
                for band, top in bands.joined(len(s)):
                    tokens, parity = sketch(s, band, top, bands)
                    own.append({"band": band, "bits": parity, "tokens": tokens.view(np.int64)})
                sketches.append(own)
            yield {"id": ids, "h": part.column("h"), "n": n, "k1": [short_key(x) for x in keys], "key": keys, "sketches": pa.array(sketches, SKETCHES)}

    return run


def _close(percent: int):
    """Keep the pairs whose parity sketches differ in no more bits than the sets may differ in shingles."""
    bands = Bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (batch.column("na").to_numpy() + batch.column("nb").to_numpy()).astype(np.int64) * (100 - bands.percent) // (100 + bands.percent)
            keep = np.empty(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), strict=True)):
                keep[i] = (int.from_bytes(x, "little") ^ int.from_bytes(y, "little")).bit_count() <= most[i]
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    return run


def _across(percent: int, forest: bool):
    """Pairs of one bucket's block that are in different components and within the Hamming bound.

    As a forest: of those, in order of their Hamming distance, only pairs that connect what the others don't."""

    def run(table: pa.Table) -> pa.Table:
        ids, comp = table.column("id").combine_chunks(), table.column("comp").combine_chunks().dictionary_encode()
        comp = comp.indices.to_numpy(zero_copy_only=False)
        side, n = table.column("side").to_numpy(), table.column("n").to_numpy().astype(np.int64)
        mine, other = table.column("mine")[0].as_py(), table.column("other")[0].as_py()
        raw = table.column("bits").to_pylist()
        width = max(map(len, raw)) + 7 & ~7
        bits = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in raw), np.uint64).reshape(len(raw), -1)
        left, right = np.flatnonzero(side == mine), np.flatnonzero(side == other)
        xs, ys, over = [], [], []
        for i in left:
            cand = right[comp[right] != comp[i]]
            if mine == other:
                cand = cand[cand > i]
            differ = np.bitwise_count(bits[i] ^ bits[cand]).sum(-1).astype(np.int64)
            most = (n[i] + n[cand]) * (100 - percent) // (100 + percent)
            ok = differ <= most
            xs.append(np.full(int(ok.sum()), i))
            ys.append(cand[ok])
            over.append(differ[ok] / np.maximum(1, most[ok]))
        x, y = (np.concatenate(v).astype(np.int64) if v else np.empty(0, np.int64) for v in (xs, ys))
        if forest and len(x):
            root = list(range(int(comp.max()) + 1))

            def find(c: int) -> int:
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            keep = []
            for at in np.argsort(np.concatenate(over), kind="stable").tolist():
                a, b = find(int(comp[x[at]])), find(int(comp[y[at]]))
                if a != b:
                    root[a] = b
                    keep.append(at)
            x, y = x[keep], y[keep]
        return pa.table({"a": ids.take(pa.array(x)), "b": ids.take(pa.array(y))})

    return run


def _sets(k: int):
    def run(docs) -> Iterator[dict]:
        for ids, texts, _ in docs:
            sets = [shingle_set(t, k) for t in texts]
            keys = [set_key(x) for x in sets]
            yield {"k1": [short_key(x) for x in keys], "key": keys, "s": [x.tobytes() for x in sets], "nameless": pc.is_null(ids)}

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(a) + len(b) - len(np.union1d(a, b))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["ka", "kb"]).rename_columns(["a", "b"])

    return run


def _table(df: DataFrame, name: str) -> DataFrame:
    return shared_table(df, name, TABLE)


def _text_hash() -> Column:
    return F.xxhash64("text")


def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, kind: str) -> DataFrame:
    """Links (a, b), as class keys, of the candidate pairs (a, b) of short keys whose shingle sets meet the threshold."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("k1")).distinct()
    # Texts are not shuffled: a bitmap picks the documents (and a few others, which meet no pair) where they lie.
    reps = classes.where(F.struct("id", "h").eqNullSafe(F.struct("pick.id", "pick.h"))).join(wanted, "k1", "left_semi")
    texts = in_bitmap(docs, F.xxhash64("id", _text_hash()), _table(bitmap(reps, F.xxhash64("id", "h")), "wanted"))
    sets = _table(map_texts(texts, _sets(k), "k1 long, key binary, s binary, nameless boolean", "id"), "sets")
    # A class without ids is known by its text alone, so all its rows come.
    sets = sets.where("not nameless").select("k1", "key", "s").unionAll(sets.where("nameless").groupBy("k1", "key").agg(F.first("s").alias("s")))
    both = pairs.join(sets.select(F.col("k1").alias("a"), F.col("key").alias("ka"), F.col("s").alias("sa")), "a").join(
        sets.select(F.col("k1").alias("b"), F.col("key").alias("kb"), F.col("s").alias("sb")), "b"
    )
    with small_batches(docs.sparkSession, PAIR_ROWS, PAIR_BYTES):
        return _table(both.select("ka", "kb", "sa", "sb").mapInArrow(_linked(percent), "a binary, b binary"), "links")


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``.

    A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, a set holds the distinct k-word shingles (the whole sequence
    where there are fewer words).  Sets link when ``100 * |A and B| >= percent * |A or B|``; ``component_id`` is the smallest
    id reachable over links.  Texts without words (null, empty, blank) link with nothing and are their own component.  Rows
    without an id link as others do, and joined ones carry links on; their component is null where none of its rows has an id.
    Rows that repeat an id are rows of their own, each with its own text's component.  An empty table gives an empty result; only
    the id and the text are read, so no name can clash.

    1. Equal sets fall together under a 128-bit key: a class.  Copies are never paired with each other.
    2. Classes emit tokens (``sketch``); the smallest class that has a token is paired with the others that have it.
    3. Pairs outside the Hamming bound go; shingle sets decide on the rest; components of those links.
    4. In buckets that still hold several components, members are compared across components under the Hamming bound, in
       blocks, and decided in the same way: first the closest pairs that would connect a block, then all that are left.
       So no bucket is expanded into all its pairs, yet no link is lost.
    """
    found = _linked_rows(docs, id_col, text_col, k, percent)
    return found.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("smallest").alias("component_id"))


def _linked_rows(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """``id, h, n, smallest`` of each row: its id, the hash of its text, the size of its set, the smallest id of its component."""
    kind = id_type(docs, id_col)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"id {kind}, h long, n int, k1 long, key binary, sketches array<struct<band:int,bits:binary,tokens:array<long>>>"
    keyed = _table(map_texts(rows, _sketch_docs(k, percent), schema, "id", also={"h": _text_hash()}), "keys")
    # The row whose text is read again for its class: the one with the smallest id, or, if no row has one, any.
    pick = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "h"))
    classes = with_group(
        keyed.where("n > 0").select("id", "h", "n", "k1", "key"), ["key"], F.xxhash64("id", "h"), {"rep": F.min("id"), "pick": pick},
        {"rep": F.min("rep"), "pick": F.min("pick")},
    )
    classes = _table(classes, "classes")
    sketches = keyed.where("sketches is not null").select("k1", "n", F.explode("sketches").alias("s"))
    short = _table(
        sketches.groupBy("k1", F.col("s.band").alias("band")).agg(F.min("n").alias("n"), F.min("s.bits").alias("bits")), "short"
    )
    tokens = sketches.select("k1", F.explode("s.tokens").alias("token"))
    # Nearly all tokens are distinct, so a task counts about as many groups as it reads tokens.
    with small_batches(docs.sparkSession, split=SPLIT_BYTES):
        buckets = _table(
            tokens.groupBy("token").agg(F.min("k1").alias("a"), F.max("k1").alias("z"), F.count("*").alias("size")).where("a <> z").drop("z"),
            "buckets",
        )
    band = F.col("token").bitwiseAND(F.lit(BAND_MASK)).cast("int").alias("band")
    often = in_bitmap(tokens, F.col("token"), _table(bitmap(buckets, F.col("token")), "tokens"))
    members = _table(often.join(buckets, "token"), "members")
    free_shuffles(docs.sparkSession)
    stars = members.where("k1 <> a").select(band, "a", F.col("k1").alias("b")).distinct()
    near = (
        stars.join(short.select(F.col("k1").alias("a"), "band", F.col("n").alias("na"), F.col("bits").alias("xa")), ["a", "band"])
        .join(short.select(F.col("k1").alias("b"), "band", F.col("n").alias("nb"), F.col("bits").alias("xb")), ["b", "band"])
        .select("a", "b", "na", "nb", "xa", "xb")
        .mapInArrow(_close(percent), "a long, b long")
        .distinct()
    )
    links = _verify(_table(near, "near"), classes, rows, k, percent, kind)
    found = components(links, TABLE)
    free_shuffles(docs.sparkSession)  # what was broadcast stays in the executors' heap until then

    # Once with forests, which join most of what is left, then with every pair across components that is left.
    for forest in (True, False):
        across = _pairs_across(members, found, short, percent, forest)
        if not across.isEmpty():
            links = links.unionAll(_verify(across, classes, rows, k, percent, kind))
            found = components(links, TABLE)
            free_shuffles(docs.sparkSession)
    # The smallest id of each component, through the smallest id of each of its classes.
    least = _table(
        found.join(classes.where("id = rep").select(F.col("key").alias("node"), "rep").distinct(), "node")
        .groupBy("component").agg(F.min("rep").alias("smallest")).join(found, "component").select(F.col("node").alias("key"), "smallest"),
        "least",
    )
    linked = classes.join(least, "key", "left").select("id", "h", "n", F.coalesce("smallest", "rep", "id").alias("smallest"))
    return linked.unionAll(keyed.where("n = 0").select("id", "h", "n", F.col("id").alias("smallest")))


def _pairs_across(members: DataFrame, found: DataFrame, short: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Candidate pairs (a, b) in buckets that hold several components."""
    label = found.select(_short(F.col("node")).alias("k1"), _short(F.col("component")).alias("comp"))
    label = label.groupBy("k1").agg(F.min("comp").alias("comp"))
    labelled = members.where("size > 2").join(label, "k1", "left").select("token", "k1", "size", F.coalesce("comp", "k1").alias("comp"))
    labelled = _table(labelled, "labelled")
    mixed = labelled.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    band = F.col("token").bitwiseAND(F.lit(BAND_MASK)).cast("int").alias("band")
    inside = labelled.join(_table(mixed, "mixed"), "token").distinct().withColumn("band", band).join(short, ["k1", "band"])
    count = F.ceil(F.col("size") / F.lit(BLOCK_ROWS)).cast("int")
    parts = inside.withColumn("side", F.pmod(F.xxhash64("k1"), count).cast("int")).withColumn(
        "with", F.explode(F.sequence(F.lit(0), count - 1))
    )
    blocks = parts.select(
        "token", F.least("side", "with").alias("mine"), F.greatest("side", "with").alias("other"), "side", F.col("k1").alias("id"), "n", "bits", "comp"
    ).repartition(shuffle_partitions(members.sparkSession), "token", "mine", "other")
    pairs = blocks.groupBy("token", "mine", "other").applyInArrow(_across(percent, forest), "a long, b long")
    return _table(pairs.distinct(), "across")


def _short(key):
    """The short key of a class key: its first eight bytes as a signed number."""
    return F.conv(F.hex(F.substring(key, 1, 8)), 16, -10).cast("long")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; all columns stay as they are.

    All rows of an id stay or go together: they go if one of them is in a component with a smaller id.  A row without an id goes if its
    component has one."""
    with scratch() as own:
        found = _linked_rows(docs, id_col, text_col, k, percent).where(~F.col("id").eqNullSafe(F.col("smallest")))
        lost = own.keep(found.select(_row_key(F.col("id"), F.col("h")).alias("_lost")).distinct(), "lost")
    # A bitmap tells which rows need to be moved to be looked up.
    key = _row_key(F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    moved, still = split_by_bitmap(docs, key, _table(bitmap(lost, F.col("_lost")), "lost-ids"))
    name = unused(docs, "_key")
    moved = moved.withColumn(name, key)
    return still.unionAll(moved.join(lost, moved[name].eqNullSafe(lost["_lost"]), "left_anti").drop(name))


def _row_key(key: Column, text_hash: Column) -> Column:
    """What a row is told by: its id, or its text's hash if it has none."""
    return F.struct(key.alias("id"), F.when(key.isNull(), text_hash).alias("h"))
