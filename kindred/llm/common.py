"""Helpers shared by the operators: Arrow document maps, salted group statistics, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import with_group
from ..operators.tables import shared_table

#: Characters of text that one step of an Arrow map holds as Python words at a time.
STEP_CHARS = 1 << 20

#: Words whose hashes a Python worker remembers.
MEMO_WORDS = 200_000


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, options: dict | None = None, rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is the smallest node that can be reached.

    Alternating large-star and small-star steps: neighbours are re-linked to the smallest one known until nothing
    changes.  Each round is written to the shared folder, with ``options`` of the writer.  Minimum labels are aggregated
    map-side and joined salted, so a node with very many neighbours does not land in one task.
    """
    e = shared_table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", options)
    for _ in range(rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_group(both, ["u"], F.col("v"), {"m": F.min("v")}, {"m": F.min("m")})
        large = large.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        small = with_group(large, ["u"], F.col("v"), {"m": F.min("v")}, {"m": F.min("m")})
        small = small.select(
            F.explode(
                F.array(
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        ).select("e.u", "e.v").where("u <> v").distinct()
        after = shared_table(small, "edges", options)
        e = after
        # A fixed point: every node has one edge, and it leads to a node that has none of its own.
        forks = after.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("w")).where("v <> w").select("u", "v")
        chains = after.join(after.select(F.col("u").alias("v")), "v", "left_semi").select("u", "v")
        if forks.unionAll(chains).isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    pairs = e.groupBy("u").agg(F.min("v").alias("component"))
    roots = e.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), "component").unionAll(roots.select("node", F.col("node").alias("component")))


# --- documents in Arrow batches --------------------------------------------------------------------------------------


def steps(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``STEP_CHARS`` of text each; a longer text is a slice of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + STEP_CHARS, "right")))
        yield batch.slice(start, end - start)
        start = end


_owner = [""]
_caches: list[Callable[[], None]] = []


def forgets(clear: Callable[[], None]) -> None:
    """Register how a module's memo is emptied."""
    _caches.append(clear)


def own_memos(owner: str) -> None:
    """A Python worker outlives its tasks.  Memos of other operators are emptied when one begins, so they don't add up."""
    if _owner[0] != owner:
        for clear in _caches:
            clear()
        gc.collect()
        trim()
        _owner[0] = owner


def trim() -> None:
    """Give memory that was freed back to the system: a worker outlives its tasks, and arrays leave holes behind."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def small_batches(
    spark: SparkSession, rows: int | None = None, size: int | None = None, read: int | None = None, split: int | None = None
) -> Iterator[None]:
    """Arrow batches of fewer rows or bytes, ``read`` rows from Parquet at a time and ``split`` bytes of it a task, while something with
    large rows is computed."""
    wanted = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size,
        "spark.sql.parquet.columnarReaderBatchSize": read, "spark.sql.files.maxPartitionBytes": split,
    }
    before = {k: spark.conf.get(k) for k, v in wanted.items() if v is not None}
    for k in before:
        spark.conf.set(k, wanted[k])
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def id_type(df: DataFrame, id_col: str) -> str:
    return df.schema[id_col].dataType.simpleString()


def map_texts(
    docs: DataFrame,
    fn: Callable[[Iterator[tuple[pa.Array, list[str], pa.RecordBatch]]], Iterator[dict]],
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    also: dict[str, Column] | None = None,
    encoded: bool = False,
) -> DataFrame:
    """Run ``fn`` over (ids, texts, batch) of each partition in bounded steps; a null text is empty.  ``fn`` yields
    columns by name.  Only the id, the text and ``also`` are read, so other columns of ``docs`` can't clash.
    ``encoded`` texts come as UTF-8 bytes."""
    spark_schema = docs.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_memos(fn.__module__)

        def docs_in() -> Iterator[tuple[pa.Array, list[str], pa.RecordBatch]]:
            for batch in batches:
                for part in steps(batch):
                    texts = part.column("text")
                    yield part.column("id"), (texts.cast(pa.binary()) if encoded else texts).to_pylist(), part

        for out in fn(docs_in()):
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c := out[f.name], (pa.Array, pa.ChunkedArray)) and c.type == f.type else pa.array(c, f.type) for f in arrow],
                schema=arrow,
            )

    return docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[c.alias(n) for n, c in (also or {}).items()]
    ).mapInArrow(run, spark_schema)


class WordHashes(dict):
    """64-bit hashes of byte words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


WORDS = WordHashes()
forgets(WORDS.clear)

#: bytes.split() parts at exactly [\x20\x09-\x0D], and bytes.lower() changes A-Z alone.
ALNUM = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256)).lower()


def space_words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def alnum_words(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM).split()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
        return x ^ (x >> np.uint64(32))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of a sequence of word hashes, in order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = mix(words[:n] + np.uint64(0x9E3779B97F4A7C15))
        for i in range(1, k):
            h = mix(h * np.uint64(0x2545F4914F6CDD1D) + words[i : n + i])
    return h
