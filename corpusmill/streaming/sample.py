"""A seeded percent sample of a stream, saved as a table."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from corpusmill.functions.constants import SEED
from corpusmill.operators.sampling import percent_sample
from corpusmill.sources.tables import scan_saved, scan_stream


def save_percent_sample(
    stream: DataFrame,
    percent: float,
    keys: list[str],
    path: str,
    checkpoint: str,
    seed: int = SEED,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    timeout: int | None = None,
) -> None:
    """Sample all input available now, apply a row-local ``transform``, and append to ``path``.

    The sample is decided per row by its key, so it needs no state, and a restart from the
    checkpoint continues it without repeating or losing rows.
    """
    sampled = percent_sample(stream, percent, keys, seed)
    if transform is not None:
        sampled = sampled.transform(transform)
    query = (
        sampled.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    try:
        finished = query.awaitTermination(timeout)
        if timeout is not None and not finished:
            raise TimeoutError(f"the stream did not finish within {timeout} seconds")
    finally:
        query.stop()


def sample_stream_from(spark: SparkSession, recipe: dict[str, Any]) -> DataFrame:
    """The recipe's first entry, a folder of Parquet files, sampled as a stream to ``output_path``.

    ``percent``, ``keys`` and ``checkpoint`` say how; a rerun takes the files that came since.
    """
    source = recipe["datasets"][0]["path"]
    schema = spark.read.parquet(source).schema
    path = recipe.get("output_path", "stream_sample")
    save_percent_sample(
        scan_stream(spark, source, schema),
        recipe["percent"],
        recipe.get("keys", ["id"]),
        path,
        recipe["checkpoint"],
        recipe.get("seed", SEED),
    )
    return scan_saved(spark, path, schema)
