"""Weights inside groups: nucleus cut, softmax and weighted draw, for groups of any size.

Sums are exact, so results don't depend on how the rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.constants import SEED
from corpusmill.functions.hashing import unit_interval
from corpusmill.operators.ordering import RANGE_ROWS, grouped_running_total
from corpusmill.operators.skew import null_safe


def top_p(
    df: DataFrame,
    group: str,
    weight: str,
    keys: list[str],
    p: float,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Per group, rows by falling weight as long as the share before them is at most ``p``.

    The heaviest row is always kept. ``keys`` break ties. Fractional weights count to 12 decimals.
    """
    order = [F.col(weight).desc(), *[F.col(k) for k in keys]]
    summed = grouped_running_total(df, group, order, weight, "_before", "_all", range_rows)
    share = F.lit(p) * F.col("_all").cast("double")
    return summed.where(F.col("_before").cast("double") <= share).drop("_before", "_all")


def softmax(
    df: DataFrame, group: str, score: str, name: str = "probability", temperature: float = 1.0
) -> DataFrame:
    """``exp((x - max) / T)`` over its sum in the group.

    Maximum and sum are aggregates, which combine map-side, and are joined back to the rows. The
    terms, at most 1, are summed as decimals of 18 places; one of them is 1, so that is their
    precision.
    """
    peaks = df.groupBy(group).agg(F.max(score).alias("_max"))
    raised = F.exp((F.col(score) - F.col("_max")) / F.lit(temperature))
    top = null_safe(df, peaks, [group]).withColumn("_e", raised)
    sums = top.groupBy(group).agg(F.sum(F.col("_e").cast("decimal(38,18)")).alias("_sum"))
    whole = null_safe(top, sums, [group])
    return whole.withColumn(name, F.col("_e") / F.col("_sum").cast("double")).drop("_max", "_e", "_sum")


def weighted_draw(
    df: DataFrame, group: str, weight: Column, keys: list[str], seed: int = SEED
) -> DataFrame:
    """One row per group, drawn with probability proportional to its weight.

    The smallest ``-ln(u) / weight`` wins, found by an aggregate of numbers; rows are only gathered
    where they have it, and of several the one with the smallest keys is taken.
    """
    rest = [c for c in df.columns if c != group]
    columns = [F.col(k) for k in keys]
    ticketed = df.where(weight > 0).withColumn(
        "_ticket", -F.ln(unit_interval(seed, *columns)) / weight
    )
    least = ticketed.groupBy(group).agg(F.min("_ticket").alias("_least"))
    winners = null_safe(ticketed, least, [group]).where("_ticket = _least")
    row = F.struct(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.struct(*rest).alias("_row"))
    drawn = winners.groupBy(group).agg(F.array_min(F.collect_list(row))["_row"].alias("_row"))
    return drawn.select(group, "_row.*")
