"""Stateless seeded draws.

Each draw hashes ``seed:purpose:key...``, so it depends neither on partitioning
nor on any earlier draw, and a recomputed task reproduces it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42
_SCALE = 4294967296  # 2^32


def digest(purpose: str, *keys: Column, seed: int = SEED) -> Column:
    """32 hex digits for one drawing slot."""
    return F.md5(F.concat_ws(":", F.lit(f"{seed}:{purpose}"), *[k.cast("string") for k in keys]))


def uniform(purpose: str, *keys: Column, seed: int = SEED) -> Column:
    """Double in [0, 1)."""
    head = F.substring(digest(purpose, *keys, seed=seed), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") / F.lit(float(_SCALE))


def integer(purpose: str, low: Column | int, high: Column | int, *keys: Column, seed: int = SEED) -> Column:
    """Whole number between ``low`` and ``high``, both ends included."""
    lo = F.lit(low) if isinstance(low, int) else low
    hi = F.lit(high) if isinstance(high, int) else high
    u = uniform(purpose, *keys, seed=seed)
    return (lo + F.floor(u * (hi - lo + F.lit(1)))).cast("bigint")


def choice(purpose: str, options: list[str], *keys: Column, seed: int = SEED) -> Column:
    """One of ``options``."""
    pos = F.floor(uniform(purpose, *keys, seed=seed) * F.lit(len(options))).cast("int") + 1
    return F.element_at(F.array(*[F.lit(o) for o in options]), pos)


def chance(purpose: str, probability: float, *keys: Column, seed: int = SEED) -> Column:
    """True with the given probability."""
    return uniform(purpose, *keys, seed=seed) < F.lit(probability)
