"""A lookup join that neither broadcasts an unchecked table nor shuffles a hot key to one task."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_BYTES = 128 << 20  # data of a broadcast table; its hash table takes a few times that
ROW_OVERHEAD = 32
SALTS = 16  # tasks, at least, that share a key which the table lacks


def lookup_join(
    facts: DataFrame,
    table: DataFrame,
    keys: list[str],
    heat: str,
    how: str = "left",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    salts: int = SALTS,
) -> DataFrame:
    """Join ``facts`` to ``table``, which has one row per key and should be staged.

    ``heat`` is how often a key occurs. The table's data is measured first, text lengths included.
    Within the limit it is broadcast whole. Beyond it, the keys above a heat threshold are
    broadcast, as many as fit, and the other keys are joined in the same pass over the facts, salted
    by a hash of the row, so that a key which many facts have and the table lacks is shared by
    ``salts`` tasks. Facts that are settled already, by a hot key or for want of a key, are spread
    evenly. Every key is looked up either way.
    """
    size = table.agg(F.sum(_row_bytes(table)).alias("bytes")).first()["bytes"] or 0
    if size <= max_broadcast_bytes:
        return facts.join(F.broadcast(table.drop(heat)), keys, how)

    level = hot_level(table, heat, max_broadcast_bytes)
    values = [c for c in table.columns if c not in (*keys, heat)]
    hot = table.where(_bits(heat) >= level).select(
        *keys, *[F.col(c).alias(f"_hot_{c}") for c in values], F.lit(True).alias("_hot")
    )
    cold = table.where(_bits(heat) < level).select(*keys, *values, F.lit(True).alias("_cold"))
    cold = cold.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    mark = F.xxhash64(*[c for c, kind in facts.dtypes if not kind.startswith("map")])
    settled = F.col("_hot").isNotNull() | reduce(or_, [F.col(k).isNull() for k in keys])
    salt = F.when(settled, F.pmod(mark, F.lit(1 << 20)) + salts).otherwise(F.pmod(mark, F.lit(salts)))
    marked = facts.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt.cast("int"))
    joined = marked.join(cold, [*keys, "_salt"], "left")
    if how != "left":
        joined = joined.where(F.col("_hot").isNotNull() | F.col("_cold").isNotNull())
    others = [c for c in facts.columns if c not in keys]
    found = [F.when(F.col("_hot").isNotNull(), F.col(f"_hot_{c}")).otherwise(F.col(c)).alias(c) for c in values]
    return joined.select(*keys, *others, *found)


def hot_level(table: DataFrame, heat: str, max_bytes: int) -> int:
    """Smallest bit length of ``heat`` from which on the rows fit into ``max_bytes``.

    The histogram has one row per bit length, 64 at most.
    """
    histogram = table.groupBy(_bits(heat).alias("bits")).agg(
        F.sum(_row_bytes(table)).alias("bytes")
    )
    level, kept = 65, 0
    for row in sorted(histogram.collect(), key=lambda r: -r["bits"]):
        kept += row["bytes"]
        if kept > max_bytes:
            break
        level = row["bits"]
    return level


def _bits(heat: str) -> Column:
    return F.length(F.bin(F.col(heat).cast("bigint")))


def _row_bytes(table: DataFrame) -> Column:
    """Text by its length, arrays by eight or sixteen bytes an element, everything else as eight."""
    sizes = [
        F.coalesce(F.octet_length(name), F.lit(0))
        if kind == "string"
        else F.greatest(F.size(name), F.lit(0)) * (16 if "struct" in kind else 8)
        if kind.startswith("array")
        else F.lit(8)
        for name, kind in table.dtypes
    ]
    return reduce(add, sizes, F.lit(ROW_OVERHEAD)).cast("bigint")


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with null equal to null; the right side's keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"_right_{k}" for k in keys])
