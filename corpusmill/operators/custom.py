"""Places for a caller's own code."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_batches(
    df: DataFrame,
    columns: list[str],
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    added: str,
    remove: list[str] | None = None,
) -> DataFrame:
    """Append what ``fn`` makes of batches of ``columns``: ``added`` is its schema as DDL text.

    For code that no expression can state. Only the named columns travel to Python, in Arrow
    batches; the others stay where they are. ``fn`` returns one row per row given.
    """

    @F.pandas_udf(f"struct<{added}>")
    def call(batch: pd.DataFrame) -> pd.DataFrame:
        return fn(batch)

    made = df.withColumn("_made", call(F.struct(*columns)))
    kept = [c for c in df.columns if c not in (remove or [])]
    return made.select(*kept, "_made.*")
