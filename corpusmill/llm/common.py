"""What the operators share: words, unused column names, ranked order over a whole table."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.session import stage

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def once(key, make):
    """What ``make`` returns, made once in a Python worker and kept for its later tasks."""
    held = sys.modules.setdefault("_corpusmill_held", types.ModuleType("_corpusmill_held")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the caller's columns are called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def packed(df: DataFrame, *needed: str) -> tuple[DataFrame, str]:
    """The needed columns, and all columns of ``df`` as one under a name that is returned: what an
    operator adds can't clash with the caller's columns, and they come back with ``name.*``."""
    name = unused(df.select(*needed), "row")
    return df.select(*needed, F.struct(*df.columns).alias(name)), name


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACES)
    return F.filter(parts, lambda w: w != "")


def ranked(df: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """0-based position of each row in ``order``, without a window over the whole table.

    The rows are range-partitioned and staged; each partition numbers its own and adds the rows of
    earlier partitions, one number for each partition.
    """
    part = unused(df, "_part")
    before = unused(df, "_before")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = stage(
        df.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()), label
    )
    sizes = cut.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return (
        cut.withColumn(name, inside)
        .join(F.broadcast(offsets), part)
        .withColumn(name, (F.col(name) + F.col(before)).cast("bigint"))
        .drop(part, before)
    )
