"""Sinks: tables partitioned by (config, split), and the view of everything as config ``all``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALL = "all"
LAYOUT = ("config", "split")


def write_splits(
    df: DataFrame,
    path: str,
    layout: tuple[str, ...] = LAYOUT,
    mode: str = "errorifexists",
    max_records_per_file: int = 5_000_000,
) -> None:
    """Write all partitions in one pass.

    The rebalance hint gathers each partition into few files and lets adaptive execution cut a
    partition that outgrows a task, so one config holding most rows is still written in parallel.
    """
    (
        df.hint("rebalance", *layout)
        .write.mode(mode)
        .option("maxRecordsPerFile", max_records_per_file)
        .partitionBy(*layout)
        .parquet(path)
    )


def save(df: DataFrame, path: str = "combined_dataset", mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def with_all_config(table: DataFrame) -> DataFrame:
    """Every row under its own config and again under ``all``: nothing is written twice."""
    return table.withColumn("config", F.explode(F.array(F.col("config"), F.lit(ALL))))


def scan_published(
    spark: SparkSession, path: str, config: str = ALL, split: str | None = "train"
) -> DataFrame:
    """Read one published config; ``all`` reads the union and still prunes to the split."""
    df = spark.read.parquet(path)
    if split is not None:
        df = df.where(F.col("split") == split)
    if config == ALL:
        return df.withColumn("config", F.lit(ALL))
    return df.where(F.col("config") == config)
