"""MinHash signatures: an Arrow kernel, a native form of it, merging and similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CompatibilityError, ConfigurationError
from ..functions import hashing
from ..functions.features import WordShingles, cut_shingles

#: Features that a task signs at a time, which bounds its arrays.
STEP = 1 << 17


def _check(num_perm: int, width: int) -> None:
    if isinstance(num_perm, bool) or num_perm < 1:
        raise ConfigurationError("num_perm must be positive")
    if width not in (32, 64):
        raise ConfigurationError("width must be 32 or 64")


def _bytes(strings: pa.Array) -> list[bytes]:
    """The strings' UTF-8, cut from their buffer; Arrow's own list makes an object of its own for each first."""
    if not len(strings):
        return []
    held = strings.cast(pa.large_binary())
    _, offsets, data = held.buffers()
    ends = np.frombuffer(offsets, np.int64, len(held) + 1, held.offset * 8).tolist()
    whole, base = memoryview(data)[ends[0] : ends[-1]].tobytes() if data is not None else b"", ends[0]
    return [whole[x - base : y - base] for x, y in zip(ends, ends[1:], strict=False)]


#: Bytes of texts whose shingles a task cuts and signs at a time; a longer one by itself.
TEXT_STEP = 1 << 20


def sign(df: DataFrame, key: str, features: Column | WordShingles, num_perm: int = 128, seed: int = 1, width: int = 32) -> DataFrame:
    """``key, signature`` for each row; null or empty features give the empty signature, all ones.

    64-bit values are bit-cast to BIGINT.  Runs where the rows lie, in bounded steps, without a shuffle.
    """
    _check(num_perm, width)
    kind = df.schema[key].dataType.simpleString()
    if isinstance(features, WordShingles):
        texts = df.select(F.col(key).alias("key"), features.plain.alias("text"))
        return texts.mapInArrow(_of_texts(features.size, num_perm, seed, width), f"key {kind}, signature array<bigint>").withColumnRenamed("key", key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("features")
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, start = np.cumsum(counts), 0
            while start < batch.num_rows:
                base = ends[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(ends, base + STEP, "right")))
                flat = _bytes(pc.list_flatten(lists.slice(start, end - start)))
                yield _signed(batch.column("key").slice(start, end - start), hashing.signatures(flat, counts[start:end], num_perm, seed, width))
                start = end

    return df.select(F.col(key).alias("key"), features.alias("features")).mapInArrow(run, f"key {kind}, signature array<bigint>").withColumnRenamed("key", key)


def _signed(keys: pa.Array, values: np.ndarray) -> pa.RecordBatch:
    n, num_perm = values.shape
    wide = values.astype(np.int64 if values.dtype == np.uint32 else np.uint64).view(np.int64)
    rows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * num_perm), pa.array(wide.ravel()))
    return pa.RecordBatch.from_arrays([keys, rows], ["key", "signature"])


def _of_texts(size: int, num_perm: int, seed: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "").cast(pa.large_binary())
            _, offsets, data = texts.buffers()
            ends = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
            whole, start = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), 0
            while start < len(texts):
                end = max(start + 1, int(np.searchsorted(ends, ends[start] + TEXT_STEP, "right")) - 1)
                packed, at, lengths, counts = cut_shingles(whole[ends[start] : ends[end]], ends[start + 1 : end + 1] - ends[start], size)
                h = hashing.cut_hashes(packed, at, lengths, width)
                yield _signed(batch.column("key").slice(start, end - start), hashing.minima(h, counts, num_perm, seed, width))
                start = end

    return run


def sign_native(df: DataFrame, key: str, features: Column, num_perm: int = 128, seed: int = 1) -> DataFrame:
    """The 32-bit signatures as a plain aggregation, one minimum per permutation, with map-side combination."""
    _check(num_perm, 32)
    a, b = hashing.permutations(num_perm, seed, 32)
    rows = df.select(F.col(key), F.explode_outer(features).alias("f")).select(key, hashing.fmix32(hashing.sha1_hash32(F.col("f"))).alias("h"))
    minima = [F.coalesce(F.min(hashing.affine32(F.col("h"), x, y)), F.lit(hashing.M32)) for x, y in zip(a, b, strict=True)]
    return rows.groupBy(key).agg(F.array(*minima).alias("signature"))


def merge(signed: DataFrame, by: list[str], num_perm: int, width: int = 32) -> DataFrame:
    """Signatures of unions: element-wise minima per group; 64-bit values are compared without a sign."""
    _check(num_perm, width)
    wrong = F.raise_error(F.lit("signatures of different lengths can't be merged")).cast("bigint")
    # With the highest bit turned over, the order of BIGINTs is that of the unsigned values.
    flip = (lambda v: v.bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))) if width == 64 else (lambda v: v)
    at = [flip(F.min(flip(F.when(F.size("signature") == num_perm, F.element_at("signature", i + 1)).otherwise(wrong)))) for i in range(num_perm)]
    return signed.groupBy(*by).agg(F.array(*at).alias("signature"))


def is_empty(signature: Column, width: int = 32) -> Column:
    """Whether a signature is that of no features at all."""
    _check(1, width)
    return F.forall(signature, lambda v: v == F.lit(hashing.M32 if width == 32 else -1).cast("bigint"))


def check_compatible(left: tuple[int, int, int], right: tuple[int, int, int]) -> None:
    """(num_perm, seed, width) of two sets of signatures must be the same."""
    if left != right:
        raise CompatibilityError(f"signatures differ: (num_perm, seed, width) {left} and {right}")
