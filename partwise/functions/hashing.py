"""Seeded, partition-independent randomness. Every draw is a function of (seed, keys)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42


def _as_columns(keys):
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def hash_key(seed, *keys) -> Column:
    """Hex digest used as a random sort key."""
    parts = [c.cast("string") for c in _as_columns(keys)]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def hash_int(seed, *keys) -> Column:
    """52 random bits as BIGINT."""
    return F.conv(F.substring(hash_key(seed, *keys), 1, 13), 16, 10).cast("bigint")


def hash_uniform(seed, *keys) -> Column:
    """Uniform double in [0, 1)."""
    return hash_int(seed, *keys) / F.lit(4503599627370496.0)
