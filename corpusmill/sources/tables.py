"""Scans: split tables, saved tables, JSON arrays, streams, and positions within a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators.ordering import RANGE_ROWS, total_before
from corpusmill.operators.skew import MAX_BROADCAST_BYTES, lookup_join
from corpusmill.session import stage


def scan_split(
    spark: SparkSession,
    root: str,
    config: str | None = None,
    split: str | None = "train",
    columns: list[str] | None = None,
) -> DataFrame:
    """One (config, split) of a table partitioned by both; only its directories are read.

    ``None`` for either means all of them.
    """
    df = spark.read.parquet(root)
    if config is not None:
        df = df.where(F.col("config") == config)
    if split is not None:
        df = df.where(F.col("split") == split)
    return df.select(*columns) if columns else df


def scan_saved(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame:
    """A saved table; with ``schema`` it may be empty."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def scan_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files that each hold one JSON array of rows.

    Such a file cannot be cut, so the scan runs one task per file: give it many files.
    """
    return spark.read.schema(schema).option("multiLine", True).json(path)


def scan_stream(
    spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def list_splits(table: DataFrame) -> DataFrame:
    """The (config, split) pairs of a partitioned table; reads no data columns."""
    return table.select("config", "split").distinct()


def with_row_position(
    scan: DataFrame,
    name: str = "row_position",
    total: str | None = None,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Dense 0-based position of every row of a file scan, over all files in path order.

    The reader numbers rows within a file; only a per-file offset has to be added, so no row is
    moved. The files are counted and measured first, in Spark. Up to ``RANGE_ROWS`` files are one
    range of offsets, which one task adds up and which is broadcast; more are cut into ranges, and
    looked up by their measured size. It must be applied to the scan itself: positions are unknown
    after a shuffle or union.
    """
    file = F.col("_metadata.file_path")
    tagged = scan.select("*", F.col("_metadata.row_index").alias("_row"), file.alias("_file"))
    sizes = scan.groupBy(file.alias("_file")).agg(F.count(F.lit(1)).alias("_n"))
    size = sizes.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("_file")).alias("bytes")).first()
    if size["n"] <= range_rows and (size["bytes"] or 0) <= MAX_BROADCAST_BYTES:
        earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
        every = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        offsets = sizes.select(
            "_file",
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
            F.sum("_n").over(every).alias("_total"),
        )
        placed = tagged.join(F.broadcast(offsets), "_file")
    else:
        offsets = total_before(sizes, [F.col("_file")], "_n", "_offset", "_total", range_rows)
        placed = lookup_join(tagged, stage(offsets, "offsets"), ["_file"], "_n", "inner")
    placed = placed.withColumn(name, (F.col("_row") + F.col("_offset")).cast("bigint"))
    if total is not None:
        placed = placed.withColumn(total, F.col("_total"))
    return placed.drop("_file", "_row", "_offset", "_total")


def head_percent(scan: DataFrame, percent: int) -> DataFrame:
    """The first ``percent`` % of a scan's rows, rounded down."""
    placed = with_row_position(scan, "_position", "_rows")
    keep = F.col("_position") < F.floor(F.col("_rows") * percent / 100)
    return placed.where(keep).drop("_position", "_rows")
