"""Benchmark decontamination by winnowing: least k-gram hash per window, fingerprint join, extension of the hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmaps import bitmap, in_bitmap, split_by_bitmap, unused
from .common import alnum_words, gram_hashes, hash_words, id_type, map_texts, own_memos, shared_table, steps

#: Words of a k-gram.
GRAM = 5

#: Benchmark text, in bytes, up to which every task gets the whole fingerprint index; beyond it fingerprints are joined.
INDEX_BYTES = 8 << 20

def _rolling(x: np.ndarray, n: int, op) -> np.ndarray:
    """``op`` (minimum or maximum) over each n consecutive values, by doubling."""
    done = 1
    while done < n:
        step = min(done, n - done)
        x = op(x[:-step], x[step:])
        done += step
    return x


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the k-grams that are the least of some ``window`` consecutive ones; fewer than that are one window.

    Two sequences that share ``window`` consecutive k-grams both keep the least of them (all of them at a tie).
    """
    if len(grams) <= window:
        return np.flatnonzero(grams == grams.min()) if len(grams) else np.empty(0, np.int64)
    least = _rolling(grams, window, np.minimum)
    pad = np.zeros(window - 1, np.uint64)
    return np.flatnonzero(_rolling(np.concatenate((pad, least, pad)), window, np.maximum) == grams)


def fingerprints(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) that any shared span of ``length`` words has in common with another sequence."""
    k = min(GRAM, length)
    grams = gram_hashes(words, k) + np.uint64(k)
    at = winnow(grams, length - k + 1)
    return grams[at], at


def matches(doc: np.ndarray, item: np.ndarray, length: int, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Document spans [start, end) that extend the hits (document, item position) to common runs of ``length`` or more."""
    spans, reached = [], {}
    for p, q in hits:
        if p < reached.get(p - q, -1):
            continue
        back = min(p, q)
        differ = np.flatnonzero(doc[p - back : p][::-1] != item[q - back : q][::-1])
        left = int(differ[0]) if len(differ) else back
        on = min(len(doc) - p, len(item) - q)
        differ = np.flatnonzero(doc[p : p + on] != item[q : q + on])
        right = int(differ[0]) if len(differ) else on
        reached[p - q] = p + max(right, 1)
        if left + right >= length:
            spans.append((p - left, p + right))
    return spans


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Index:
    """Fingerprints of benchmark items, by the length that an occurrence must have."""

    def __init__(self, items: list[tuple[object, str]], window: int) -> None:
        self.ids, self.words, lengths = [], [], []
        for item, text in items:
            words = hash_words(alnum_words(text or ""))
            if len(words):
                self.ids.append(item)
                self.words.append(words)
                lengths.append(min(window, len(words)))
        self.by_length = {}
        for length in sorted(set(lengths)):
            found = [(f, i, a) for i, own in enumerate(lengths) if own == length for f, a in zip(*fingerprints(self.words[i], length), strict=True)]
            hashes = np.array([f for f, _, _ in found], np.uint64)
            order = np.argsort(hashes, kind="stable")
            self.by_length[length] = hashes[order], np.array([i for _, i, _ in found])[order], np.array([a for _, _, a in found])[order]

    def search(self, doc: np.ndarray) -> tuple[list[tuple[int, int]], list[object]]:
        """(merged hit spans, item ids) of a document's word hashes."""
        spans, items = [], set()
        for length, (hashes, item_of, at_of) in self.by_length.items():
            if len(doc) < length:
                continue
            fps, at = fingerprints(doc, length)
            lo = np.searchsorted(hashes, fps, "left")
            known = np.flatnonzero(hashes[np.minimum(lo, len(hashes) - 1)] == fps)
            hits: dict[int, list[tuple[int, int]]] = {}
            for j in known:
                for x in range(lo[j], np.searchsorted(hashes, fps[j], "right")):
                    hits.setdefault(int(item_of[x]), []).append((int(at[j]), int(at_of[x])))
            for i, own in hits.items():
                if found := matches(doc, self.words[i], length, own):
                    spans += found
                    items.add(i)
        return _merge(spans), [self.ids[i] for i in sorted(items)]


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _span_rows(spans: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in own] for own in spans], SPANS)


def _search_all(shared, item_type: pa.DataType):
    def run(docs) -> Iterator[dict]:
        index = shared.value
        for ids, texts, _ in docs:
            n, spans, items = [], [], []
            for text in texts:
                words = hash_words(alnum_words(text))
                s, i = index.search(words)
                n.append(len(words))
                spans.append(s)
                items.append(i)
            yield {"id": ids, "n_words": n, "spans": _span_rows(spans), "items": pa.array(items, pa.list_(item_type))}

    return run


class _Prints:
    """Columns of fingerprints: the key of their text, the position, and the words about it that a match of ``length`` may take in."""

    def __init__(self) -> None:
        self.key, self.at, self.length, self.fp, self.back, self.words = [], [], [], [], [], []

    def add(self, key: int, words: np.ndarray, length: int) -> None:
        fps, at = fingerprints(words, length)
        k = min(GRAM, length)
        for p, f in zip(at.tolist(), (fps ^ np.uint64(length << 56)).view(np.int64).tolist(), strict=True):
            first = max(0, p - (length - k))
            self.key.append(key)
            self.at.append(p)
            self.length.append(length)
            self.fp.append(f)
            self.back.append(p - first)
            self.words.append(words[first : p + length].tobytes())

    def columns(self, ids: pa.Array) -> dict:
        return {"id": ids.take(pa.array(self.key, pa.int64())), "at": self.at, "length": self.length, "fp": self.fp, "back": self.back, "words": self.words}


def _prints(lengths: list[int] | None, window: int):
    """Fingerprints of each text: for all ``lengths``, or (items) for the one that an occurrence of the text must have."""

    def run(docs) -> Iterator[dict]:
        for ids, texts, _ in docs:
            out = _Prints()
            for i, text in enumerate(texts):
                words = hash_words(alnum_words(text))
                for length in lengths if lengths is not None else [min(window, len(words))] if len(words) else []:
                    if len(words) >= length:
                        out.add(i, words, length)
            yield out.columns(ids)

    return run


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the document's words about each pair of equal fingerprints that are long enough, with the items that have them."""
    for batch in batches:
        keep, starts, ends = [], [], []
        rows = zip(*[batch.column(c).to_pylist() for c in ("at", "back", "words", "item_back", "item_words", "length")], strict=True)
        for i, (at, back, words, item_back, item_words, length) in enumerate(rows):
            found = matches(np.frombuffer(words, np.uint64), np.frombuffer(item_words, np.uint64), length, [(back, item_back)])
            for a, b in found:
                keep.append(i)
                starts.append(at - back + a)
                ends.append(at - back + b)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(at), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), batch.column("items").take(at)], names=["id", "start", "end", "items"]
        )


def _counts():
    def run(docs) -> Iterator[dict]:
        for ids, texts, _ in docs:
            yield {"id": ids, "n_words": [len(alnum_words(t)) for t in texts]}

    return run


def _merged():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_merge([(s["start"], s["end"]) for s in row]) for row in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), _span_rows(rows), batch.column("items")], ["id", "spans", "items"])

    return run


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("item_text")).where("item is not null and item_text is not null")


def _size(items: DataFrame) -> int:
    return items.agg(F.sum(F.octet_length("item_text")).alias("s")).first().s or 0


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, spans, items``.

    A-Z are lower-cased; words are runs of ASCII letters, digits and characters beyond ASCII.  A window is ``window``
    consecutive words of an item, or the whole of a shorter item.  ``spans`` are the maximal runs of document words that lie
    in occurrences of windows ([start, end), merged), ``n_hit`` counts those words, ``items`` the items whose windows
    occur.  Null and empty texts have no words and no hits; an item without words or id never occurs; items that repeat
    an id count once; an empty benchmark hits nothing.

    Every window of k-grams keeps its least hash, so a shared run of ``window`` words shares a kept hash, which is
    extended word by word.  A benchmark of up to ``index_bytes`` goes to every task as an index; a larger one has its
    fingerprints joined with those of the documents, both with the words about them, and each pair that meets is extended.
    """
    items = _items(benchmark, item_col, item_text_col)
    kind, item_kind = id_type(docs, id_col), id_type(benchmark, item_col)
    if _size(items) <= index_bytes:
        rows = [(r.item, r.item_text) for r in items.collect()]
        index = docs.sparkSession.sparkContext.broadcast(Index(rows, window))
        schema = f"id {kind}, n_words long, spans array<struct<start:int,end:int>>, items array<{item_kind}>"
        from pyspark.sql.pandas.types import to_arrow_type

        out = map_texts(docs, _search_all(index, to_arrow_type(benchmark.schema[item_col].dataType)), schema, id_col, text_col)
    else:
        out = _joined(docs, items, id_col, text_col, item_kind, window)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long"))
    return out.select(F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), "spans", F.array_distinct("items").alias("items"))


def _joined(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_kind: str, window: int) -> DataFrame:
    """The same by a join of fingerprints, each with the few words about it, so that no whole text is moved.

    Items that agree about a fingerprint are one row; fingerprints that no item can have are left out where they lie; the join
    has a plain exchange on both sides, so that adaptive execution can split a frequent passage."""
    schema = "at int, length int, fp long, back int, words binary"
    own = map_texts(items, _prints(None, window), f"id {item_kind}, {schema}", "item", "item_text")
    own = own.groupBy("fp", "length", "back", "words").agg(F.collect_set("id").alias("items"))
    own = shared_table(own.select("fp", "length", F.col("back").alias("item_back"), F.col("words").alias("item_words"), "items"), "item-prints")
    lengths = sorted(r.length for r in own.select("length").distinct().collect())  # at most ``window`` numbers
    # Rows are told apart by a written number, since ids may be null or repeat.
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = shared_table(rows.withColumn("id", F.monotonically_increasing_id()), "rows")
    prints = map_texts(rows, _prints(lengths, window), f"id long, {schema}", "id").drop("length")
    prints = in_bitmap(prints, F.col("fp"), shared_table(bitmap(own, F.col("fp")), "prints"))
    found = prints.join(own, "fp").mapInArrow(_extended, f"id long, start int, end int, items array<{item_kind}>")
    per_doc = found.groupBy("id").agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    per_doc = per_doc.mapInArrow(_merged(), f"id long, spans array<struct<start:int,end:int>>, items array<{item_kind}>")
    counts = map_texts(rows, _counts(), "id long, n_words long", "id").join(rows.select("id", "doc"), "id")
    return counts.join(per_doc, "id", "left").select(
        F.col("doc").alias("id"), "n_words", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast(f"array<{item_kind}>")).alias("items"),
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = 10, index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window; all columns stay as they are.

    Each row is judged by its own text, whatever its id.  With a benchmark of up to ``index_bytes`` no row moves to another task;
    with a larger one, only rows that a bitmap of the hit ones may name."""
    items = _items(benchmark, item_col, item_text_col)
    if _size(items) <= index_bytes:
        index = docs.sparkSession.sparkContext.broadcast(Index([(r.item, r.item_text) for r in items.collect()], window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own_memos(__name__)
            for batch in batches:
                for part in steps(batch, text_col):
                    texts = pc.fill_null(part.column(text_col), "").to_pylist()
                    yield part.filter(pa.array([not index.value.search(hash_words(alnum_words(t)))[1] for t in texts], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)
    row, own = unused(docs, "__row"), unused(docs, "__hit")
    rows = shared_table(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    hit = _joined(rows.select(F.col(row).alias("number"), F.col(text_col).alias("text")), items, "number", "text", id_type(benchmark, item_col), window)
    hit = shared_table(hit.where(F.size("spans") > 0).select(F.col("id").alias(own)), "hit")
    moved, still = split_by_bitmap(rows, F.col(row), shared_table(bitmap(hit, F.col(own)), "hit-rows"))
    return still.unionAll(moved.join(hit, F.col(row) == F.col(own), "left_anti")).drop(row)
