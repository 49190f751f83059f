"""Positions and running totals over a whole table without sending it through one task.

All of them cut the order into buckets that are monotone in it, total each bucket with a
map-side-combined aggregate, and add the total of the earlier buckets to a window inside the bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.hashing import hex_prefix, seeded_md5
from corpusmill.operators.skew import null_safe
from corpusmill.session import stage

HASH_DIGITS = 4  # 65,536 buckets: the largest table of offsets that hash order can have
CUT_DIGITS = 5  # a million buckets where the offsets are not broadcast and one bucket is ordered
SHARD_ROWS = 1 << 20  # rows per bucket of a dense position
RANGE_ROWS = 1 << 17  # rows of a range that one window task sorts


def _bucket_offsets(
    totals: DataFrame, bucket: str, value: str, keep: bool = False
) -> DataFrame:
    """Total of the earlier buckets; one row per bucket, so the window is small."""
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(bucket).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    return totals.select(
        bucket,
        F.coalesce(F.sum(value).over(before), F.lit(0)).cast("bigint").alias("_before"),
        F.sum(value).over(whole).cast("bigint").alias("_total"),
        *([value] if keep else []),
    )


def position_in_order(
    df: DataFrame,
    bucket: Column,
    order: list[Column],
    name: str,
    total: str | None = None,
    below: Column | None = None,
) -> DataFrame:
    """Dense 0-based position in an order whose buckets are monotone and bounded in number.

    With ``below`` only positions under that limit (an expression that may use ``_total``) are
    kept, and buckets that start beyond it never reach the shuffle.
    """
    tagged = df.withColumn("_bucket", bucket)
    totals = tagged.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    placed = tagged.join(F.broadcast(_bucket_offsets(totals, "_bucket", "_n")), "_bucket")
    if below is not None:
        placed = placed.where(F.col("_before") < below)
    inside = Window.partitionBy("_bucket").orderBy(*order)
    placed = placed.withColumn(name, F.col("_before") + F.row_number().over(inside) - 1)
    if below is not None:
        placed = placed.where(F.col(name) < below)
    if total is not None:
        placed = placed.withColumn(total, F.col("_total"))
    return placed.drop("_bucket", "_before", "_total")


def hash_position(
    df: DataFrame,
    seed: int | str,
    keys: list[str],
    name: str,
    total: str | None = None,
    below: Column | None = None,
) -> DataFrame:
    """Position in the seeded hash order of ``keys``, which must identify a row."""
    hashed = df.withColumn("_hash", seeded_md5(seed, *[F.col(k) for k in keys]))
    order = [F.col("_hash"), *[F.col(k) for k in keys]]
    bucket = hex_prefix(F.col("_hash"), HASH_DIGITS)
    return position_in_order(hashed, bucket, order, name, total, below).drop("_hash")


def first_in_hash_order(
    df: DataFrame, seed: int | str, keys: list[str], size: Column
) -> Column:
    """Condition that holds for exactly the first ``size`` rows in seeded hash order.

    ``size`` may use ``_total``, the number of rows. Two jobs over the key columns find the last
    such row: bucket counts say which bucket it lies in, and only that bucket is ordered. The
    condition itself is row-local, so wide rows are filtered or labelled where they lie.
    """
    columns = [F.col(k) for k in keys]
    hashed = df.select(*keys, seeded_md5(seed, *columns).alias("_hash"))
    hashed = hashed.withColumn("_bucket", hex_prefix(F.col("_hash"), CUT_DIGITS))
    totals = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _bucket_offsets(totals, "_bucket", "_n", keep=True)
    edge = (
        offsets.withColumn("_size", F.least(size.cast("bigint"), F.col("_total")))
        .where((F.col("_before") < F.col("_size")) & (F.col("_size") <= F.col("_before") + F.col("_n")))
        .first()
    )
    if edge is None:
        return F.lit(False)
    last = (
        hashed.where(F.col("_bucket") == edge["_bucket"])
        .orderBy("_hash", *keys)
        .offset(edge["_size"] - edge["_before"] - 1)
        .limit(1)
        .first()
    )
    types = {f.name: f.dataType for f in hashed.schema.fields}
    bound = [F.lit(last[n]).cast(types[n]).alias(n) for n in ["_hash", *keys]]
    return F.struct(seeded_md5(seed, *columns).alias("_hash"), *columns) <= F.struct(*bound)


def running_total(
    df: DataFrame, position: str, value: str, name: str, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """Sum of ``value`` over all rows with a smaller ``position``, which must be dense."""
    tagged = df.withColumn("_shard", F.floor(F.col(position) / F.lit(shard_rows)))
    totals = tagged.groupBy("_shard").agg(F.sum(value).alias("_sum"))
    offsets = _bucket_offsets(totals, "_shard", "_sum").drop("_total")
    inside = (
        Window.partitionBy("_shard")
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        tagged.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "_shard")
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_shard", "_before", "_inside")
    )


def _ranges(df: DataFrame, order: list[Column], range_rows: int) -> DataFrame:
    """``df`` staged in ranges of ``order`` of about ``range_rows`` rows, numbered by ``_shard``.

    The number of ranges follows from the number of rows alone.
    """
    staged = stage(df.withColumn("_shard", F.lit(0)), "rows")
    shards = -(-staged.count() // range_rows)
    if shards <= 1:
        return staged
    ranged = staged.repartitionByRange(shards, *order)
    return stage(ranged.withColumn("_shard", F.spark_partition_id()), "ranged")


def position_by_range(
    df: DataFrame, order: list[Column], name: str, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Dense 0-based position in ``order``, which must identify a row: rows are numbered within
    ranges, and each range adds the rows of the earlier ones, one number for each range."""
    cut = _ranges(df, order, range_rows)
    sizes = cut.groupBy("_shard").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _bucket_offsets(sizes, "_shard", "_n").drop("_total")
    inside = F.row_number().over(Window.partitionBy("_shard").orderBy(*order)) - 1
    placed = cut.withColumn(name, inside).join(offsets, "_shard")
    return placed.withColumn(name, F.col(name) + F.col("_before")).drop("_shard", "_before")


def exact(df: DataFrame, value: str, scale: int = 12) -> Column:
    """``value`` as a number whose sums don't depend on the order of addition: floating point is
    rounded to ``scale`` decimals, anything else is left as it is."""
    kind = dict(df.dtypes)[value]
    return F.col(value).cast(f"decimal(38,{scale})") if kind in ("double", "float") else F.col(value)


def grouped_running_total(
    df: DataFrame,
    group: str,
    order: list[Column],
    value: str,
    before: str,
    total: str,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Per group: sum of ``value`` over the rows ordered before this one, and over all rows.

    ``order`` must identify a row within its group. The table is cut into ranges of (group, order),
    which cuts even a group that holds a third of it, and each range adds what its group has in
    earlier ones. Sums are exact (see ``exact``), so the result is the same however it is cut.
    """
    place = [F.col(group), *order]
    cut = _ranges(df.withColumn("_value", exact(df, value)), place, range_rows)
    sums = cut.groupBy(group, "_shard").agg(F.sum("_value").alias("_sum"))
    by_shard = Window.partitionBy(group).orderBy("_shard")
    carries = sums.select(
        group,
        "_shard",
        F.sum("_sum").over(by_shard.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"),
        F.sum("_sum").over(Window.partitionBy(group)).alias(total),
    )
    shard = Window.partitionBy(group, "_shard")
    earlier = shard.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.withColumn("_inside", F.sum("_value").over(earlier))
    zero = F.lit(0)
    return (
        null_safe(inside, carries, [group, "_shard"])
        .withColumn(before, F.coalesce("_inside", zero) + F.coalesce("_carry", zero))
        .drop("_shard", "_inside", "_carry", "_value")
    )


def total_before(
    df: DataFrame,
    order: list[Column],
    value: str,
    before: str,
    total: str,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """``grouped_running_total`` over the whole table."""
    given = df.withColumn("_whole", F.lit(0))
    return grouped_running_total(given, "_whole", order, value, before, total, range_rows).drop("_whole")


def position_in_group(
    df: DataFrame, position: str, group: str, name: str, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """Dense 0-based place of each row among the rows of its ``group``, in the order of ``position``.

    ``position`` must be dense over the table. Rows are numbered within their group's part of a shard,
    ``shard_rows`` at most, and the counts of earlier shards are added, so one group may hold the
    whole table. A null group is a group: a group's part of a shard is one struct, which is never null, so
    that numbering and adding need the same exchange.
    """
    part = F.struct(F.col(group).alias("group"), F.floor(F.col(position) / F.lit(shard_rows)).alias("shard"))
    tagged = df.withColumn("_part", part)
    counts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_part.group").orderBy("_part.shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(position)) - 1
    placed = tagged.withColumn("_inside", inside).join(offsets, "_part")
    place = (F.col("_before") + F.col("_inside")).cast("bigint")
    return placed.withColumn(name, place).drop("_part", "_before", "_inside")
