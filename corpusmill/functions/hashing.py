"""Seeded pseudo-random decisions that repeat on any engine, cluster size or retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = 1 << 32


def seeded_md5(seed: int | str, *keys: Column) -> Column:
    """md5 of ``seed:key1:key2...``; null keys count as empty text."""
    parts = [F.coalesce(k.cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def hex_prefix(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def draw(seed: int | str, *keys: Column) -> Column:
    """Uniform integer in ``[0, 2^32)``."""
    return hex_prefix(seeded_md5(seed, *keys), 8)


def chosen(fraction: float, seed: int | str, *keys: Column) -> Column:
    """True for about ``fraction`` of the keys; a larger fraction keeps every earlier choice."""
    return draw(seed, *keys) < F.lit(int(fraction * SPACE))


def unit_interval(seed: int | str, *keys: Column) -> Column:
    """Uniform double strictly inside (0, 1)."""
    return (draw(seed, *keys).cast("double") + F.lit(0.5)) / F.lit(float(SPACE))
