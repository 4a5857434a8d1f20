"""Hash identities: stable over machines, row order and partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PART = "\x1f"
SPLIT_STEPS = 100_000


def digest(*parts: Column) -> Column:
    """SHA-256 hex of the parts joined by the unit separator; null parts count as empty."""
    return F.sha2(F.concat_ws(PART, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def derive_id(*parts: Column, length: int = 16) -> Column:
    """The first ``length`` hex digits of the digest."""
    return F.substring(digest(*parts), 1, length)


def derive_seed(*parts: Column) -> Column:
    """63 bits of the digest as a non-negative bigint: the low bits of its first 16 hex digits."""
    head = digest(*parts)
    high, low = (F.conv(F.substring(head, a, 8), 16, 10).cast("bigint") for a in (1, 9))
    return F.shiftleft(high.bitwiseAND(F.lit(0x7FFFFFFF)), 32).bitwiseOR(low)


def hash_split(generator: Column, family: Column, derivation: Column, seed: int, train: float, validation: float) -> Column:
    """Split of a derivation: rows of the same three ids share it, whatever the other rows are."""
    step = derive_seed(F.lit(str(seed)), F.lit("split"), generator, family, derivation) % SPLIT_STEPS
    first = int(train * SPLIT_STEPS)
    return F.when(step < first, "train").when(step < first + int(validation * SPLIT_STEPS), "validation").otherwise("test")


def package_name(c: Column) -> Column:
    """A package name in its normal form: lower case, runs of ``-_.`` as one hyphen."""
    return F.lower(F.regexp_replace(c, "[-_.]+", "-"))
