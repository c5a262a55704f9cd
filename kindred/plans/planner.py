"""Parameters and plans of a banded index: tuning, the candidate curve, sizes and advice.  Metadata, on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from ..errors import ConfigurationError

SEGMENTS = 64

# Fixed values of the size model, in bytes.
KEY, BAND_ENTRY, MEMORY_BASE, MEMORY_BAND, FILE_BAND, FILE_BASE, LAZY_BAND = 8, 16, 64, 112, 48, 736, 56

#: What to do on a cluster, by reason.
GUIDANCE = {
    "explicit_mode": "Use the storage that was named.",
    "in_memory_fits_budget": "Persist the band rows of a Deduplicator; executors hold them besides their shuffles.",
    "in_memory_exceeds_budget": "Build a StoredIndex: band hashes are read from Parquet, column by column, when a search needs them.",
    "local_metadata_exceeds_budget": "Build a StoredIndex on a shared store and give it more executors; nothing of it stays on one machine.",
    "capacity_unknown": "Build a StoredIndex until the memory that executors can spare is known.",
    "explicit_mode_exceeds_budget": "The named storage is used, but expect spills: it is larger than the budget.",
}


def probability(similarity: float, bands: int, rows: int) -> float:
    return 1.0 - (1.0 - similarity**rows) ** bands


def _area(f, start: float, end: float) -> float:
    if start == end:
        return 0.0
    step = (end - start) / SEGMENTS
    inner = sum((2.0 if i % 2 == 0 else 4.0) * f(start + i * step) for i in range(1, SEGMENTS))
    return (f(start) + f(end) + inner) * step / 3.0


def areas(threshold: float, bands: int, rows: int) -> tuple[float, float]:
    """(candidates below the threshold, misses above it), integrated by Simpson's rule."""
    return _area(lambda s: probability(s, bands, rows), 0.0, threshold), _area(lambda s: 1.0 - probability(s, bands, rows), threshold, 1.0)


def validate(threshold: float, num_perm: int) -> None:
    if not (isinstance(threshold, (int, float)) and math.isfinite(threshold) and 0.0 < threshold <= 1.0):
        raise ConfigurationError("threshold must be within (0, 1]")
    if isinstance(num_perm, bool) or not isinstance(num_perm, int) or not 1 <= num_perm <= 4096:
        raise ConfigurationError("num_perm must be within 1 and 4096")


@lru_cache(maxsize=256)
def tune(threshold: float, num_perm: int) -> tuple[int, int]:
    """(bands, rows) with bands * rows <= num_perm and the least mean of the two areas; at a tie more values used."""
    validate(threshold, num_perm)
    best: tuple[float, int, int, int] | None = None
    for bands in range(1, num_perm + 1):
        for rows in range(1, num_perm // bands + 1):
            error = 0.5 * sum(areas(threshold, bands, rows))
            if best is None or error < best[0] or (error == best[0] and bands * rows > best[1]):
                best = error, bands * rows, bands, rows
    return best[2], best[3]


@dataclass(frozen=True)
class Sizes:
    signature: int
    metadata: int
    memory: int
    file: int
    lazy: int

    @staticmethod
    def per_item(num_perm: int, bands: int, width: int) -> Sizes:
        return Sizes(
            num_perm * width // 8, KEY + BAND_ENTRY * bands, MEMORY_BASE + MEMORY_BAND * bands, KEY + FILE_BAND * bands, KEY + LAZY_BAND * bands
        )


def with_headroom(size: int) -> int:
    """Half as much again, rounded up."""
    return -(-size * 3 // 2)


def recommend(mode: str, budget: int | None, memory_fits: bool | None, stored_fits: bool | None) -> tuple[str, str]:
    """(storage, reason)."""
    if mode in ("persistent", "lazy"):
        return mode, "explicit_mode_exceeds_budget" if budget is not None and not stored_fits else "explicit_mode"
    if mode == "redis":
        return mode, "explicit_mode"
    if mode not in ("auto", "memory"):
        raise ConfigurationError(f"unknown storage mode {mode}")
    if budget is None:
        return ("persistent", "capacity_unknown") if mode == "auto" else ("memory", "explicit_mode")
    if memory_fits:
        return "memory", "in_memory_fits_budget"
    return ("persistent", "in_memory_exceeds_budget") if stored_fits else ("redis", "local_metadata_exceeds_budget")


def plan(
    items: int, threshold: float = 0.8, num_perm: int = 128, budget: int | None = None, mode: str = "auto", width: int = 32,
    params: tuple[int, int] | None = None,
) -> dict:
    """The whole report; with ``params`` it explains an index that exists."""
    if items < 1 or budget == 0:
        raise ConfigurationError("items and budget must be positive")
    validate(threshold, num_perm)
    bands, rows = params or tune(threshold, num_perm)
    if bands < 1 or rows < 1 or bands * rows > num_perm:
        raise ConfigurationError("bands and rows must be positive and use no more than num_perm values")
    size = Sizes.per_item(num_perm, bands, width)
    memory, lazy = items * size.memory, items * size.lazy
    memory_fits = None if budget is None else with_headroom(memory) <= budget
    stored_fits = None if budget is None else with_headroom(lazy) <= budget
    storage, reason = recommend(mode, budget, memory_fits, stored_fits)
    below, above = areas(threshold, bands, rows)
    return {
        "expected_items": items, "threshold": float(threshold), "num_perm": num_perm, "bands": bands, "rows": rows,
        "parameter_source": "existing" if params else "tuned", "used_permutations": bands * rows, "unused_permutations": num_perm - bands * rows,
        "candidate_probability_at_threshold": probability(threshold, bands, rows),
        "similarity_at_50_percent_candidates": (1.0 - 0.5 ** (1.0 / bands)) ** (1.0 / rows),
        "false_positive_area": below, "false_negative_area": above, "bucket_memberships_per_item": bands,
        "signature_bytes_per_item": size.signature, "signature_bytes": items * size.signature, "index_metadata_bytes_per_item": size.metadata,
        "index_metadata_bytes": items * size.metadata, "in_memory_index_bytes_per_item": size.memory, "in_memory_index_bytes": memory,
        "persistent_index_bytes_per_item": size.file, "persistent_index_bytes": FILE_BASE + items * size.file,
        "lazy_resident_bytes_per_item": size.lazy, "lazy_resident_bytes": lazy, "in_memory_with_headroom_bytes": with_headroom(memory),
        "lazy_with_headroom_bytes": with_headroom(lazy), "memory_budget_bytes": budget, "in_memory_fits_budget": memory_fits,
        "persistent_fits_budget": stored_fits, "requested_storage": mode, "recommended_storage": storage, "recommendation_reason": reason,
        "recommendation_guidance": GUIDANCE[reason],
    }


PLAN_SCHEMA = (
    "expected_items long, threshold double, num_perm int, bands int, rows int, parameter_source string, used_permutations int, "
    "unused_permutations int, candidate_probability_at_threshold double, similarity_at_50_percent_candidates double, "
    "false_positive_area double, false_negative_area double, bucket_memberships_per_item long, signature_bytes_per_item long, "
    "signature_bytes long, index_metadata_bytes_per_item long, index_metadata_bytes long, in_memory_index_bytes_per_item long, "
    "in_memory_index_bytes long, persistent_index_bytes_per_item long, persistent_index_bytes long, lazy_resident_bytes_per_item long, "
    "lazy_resident_bytes long, in_memory_with_headroom_bytes long, lazy_with_headroom_bytes long, memory_budget_bytes long, "
    "in_memory_fits_budget boolean, persistent_fits_budget boolean, requested_storage string, recommended_storage string, "
    "recommendation_reason string, recommendation_guidance string"
)


def plan_frame(spark: SparkSession, plans: list[dict]) -> DataFrame:
    """Plans as rows."""
    return spark.createDataFrame([tuple(p.values()) for p in plans], PLAN_SCHEMA)
