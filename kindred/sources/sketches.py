"""Signatures as self-describing sketches, for exchange with other programs."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CompatibilityError
from ..functions import hashing


@dataclass(frozen=True)
class Scheme:
    """How a sketch was made.  Two sketches can be compared only if all of it is equal: the same seed does not make the same
    permutations in every program."""

    name: str
    hash_function: str
    dtype: str
    seed: int
    num_perm: int
    multipliers: tuple[int, ...]
    offsets: tuple[int, ...]

    @staticmethod
    def of(num_perm: int, seed: int, width: int = 32) -> Scheme:
        a, b = hashing.permutations(num_perm, seed, width)
        return Scheme(f"affine{width}", f"sha1_hash{width}", f"uint{width}", seed, num_perm, a, b)


def is_compatible(left: Scheme, right: Scheme) -> bool:
    return left == right


def export_sketches(signed: DataFrame, key: str, scheme: Scheme) -> DataFrame:
    """``key, values`` (unsigned) with the whole scheme in columns of its own."""
    width = 64 if scheme.dtype == "uint64" else 32
    number = lambda v: v.cast("decimal(20,0)") + F.when(v < 0, F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(0)
    values = F.transform("signature", number) if width == 64 else F.transform("signature", lambda v: v.cast("decimal(20,0)"))
    listed = {k: F.array(*[F.lit(str(x)).cast("decimal(20,0)") for x in v]) if isinstance(v, tuple) else F.lit(v) for k, v in asdict(scheme).items()}
    return signed.select(F.col(key).alias("key"), F.transform(values, lambda v: v.cast("decimal(20,0)")).alias("values"), *[c.alias(k) for k, c in listed.items()])


def import_sketches(sketches: DataFrame, scheme: Scheme) -> DataFrame:
    """``key, signature`` of sketches of exactly this scheme; any other is a CompatibilityError that says what differs."""
    for name, want in asdict(scheme).items():
        own = F.col(name)
        same = own == (F.array(*[F.lit(str(x)).cast("decimal(20,0)") for x in want]) if isinstance(want, tuple) else F.lit(want))
        if not sketches.where(~F.coalesce(same, F.lit(False))).isEmpty():
            raise CompatibilityError(f"a sketch has another {name}")
    if not sketches.where((F.size("values") != scheme.num_perm) | F.exists("values", lambda v: (v < 0) | (v >= F.lit(str(1 << int(scheme.dtype[4:]))).cast("decimal(20,0)")))).isEmpty():
        raise CompatibilityError("a sketch has values of another number or range")
    signed = F.transform("values", lambda v: F.when(v < F.lit(str(1 << 63)).cast("decimal(20,0)"), v).otherwise(v - F.lit(str(1 << 64)).cast("decimal(21,0)")).cast("bigint"))
    return sketches.select("key", signed.alias("signature"))
