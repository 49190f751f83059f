"""Packing examples into blocks without cutting any: best fit, longest first.

Only the histogram of lengths decides how blocks are filled, and it has no more rows than a block has
places. So the filling is planned on the driver, exactly as if the examples were placed one by one, in
runs of blocks that are filled alike; each example then finds its block by its place among the
examples of its length.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.ordering import SHARD_ROWS, position_in_group
from corpusmill.operators.tokens import EOS, ID_ROWS, PAD


@dataclass
class Share:
    """Examples of one length from place ``begin`` on: ``each`` of them to a block, from ``block`` on,
    behind ``used`` tokens that the block holds already."""

    size: int
    begin: int
    block: int
    each: int
    used: int


def best_fit(histogram: dict[int, int], length: int) -> tuple[list[Share], int]:
    """Shares of every length, and the number of blocks of ``length`` tokens.

    Longest first, each example goes where it leaves the least room, to the first of equal blocks, and
    to a new block where it fits into none. Blocks that are filled alike are one run; a length splits
    one run at most, so runs and shares depend on the lengths there are, not on how many examples.
    """
    shares: list[Share] = []
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> heap of (first block, blocks)
    blocks = 0
    for size in sorted(histogram, reverse=True):
        if not 0 < size <= length:
            raise ValueError(f"an example of {size} tokens fits into no block of {length}")
        placed, left = 0, histogram[size]
        while left:
            fitting = min((r for r in room if r >= size), default=None)
            if fitting is None:
                each = length // size
                count = -(-left // each)
                first, fitting, blocks = blocks, length, blocks + count
            else:
                first, count = heapq.heappop(room[fitting])
                each = fitting // size
                if not room[fitting]:
                    del room[fitting]
            full, last = divmod(min(left, each * count), each)
            shares.append(Share(size, placed, first, each, length - fitting))
            for blocks_of, taken in ((full, each), (1 if last else 0, last), (count - full - bool(last), 0)):
                if blocks_of:
                    if fitting - taken * size:
                        heapq.heappush(room.setdefault(fitting - taken * size, []), (first, blocks_of))
                    first += blocks_of
            placed += full * each + last
            left -= full * each + last
    return shares, blocks


def _plan_table(spark: SparkSession, shares: list[Share]) -> DataFrame:
    """One row for each length with its shares in order; no more rows than a block has places."""
    by_size: dict[int, list[dict]] = {}
    for s in shares:
        by_size.setdefault(s.size, []).append({"begin": s.begin, "block": s.block, "each": s.each, "used": s.used})
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("begin", "block", "each", "used")]))
    columns = {"_size": pa.array(by_size.keys(), pa.int64()), "_shares": pa.array(by_size.values(), kind)}
    return spark.createDataFrame(pa.table(columns))


def whole_plan(
    df: DataFrame, position: str, n_tokens: str, length: int, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """Adds ``size``, ``block`` and ``start``: the row's tokens with its end marker, the block that holds
    them all, and the place in the block where they begin.

    ``position`` must be dense. A row of more than ``length - 1`` tokens is taken as cut to that; a null
    count is none. Columns of the three names are replaced. One task orders ``shard_rows`` rows of a size
    with all their columns.
    """
    tokens = F.coalesce(F.col(n_tokens), F.lit(0)).cast("bigint")
    sized = df.withColumn("size", F.least(tokens, F.lit(length - 1)) + 1)
    histogram = {r["size"]: r["n"] for r in sized.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares, _ = best_fit(histogram, length)
    placed = position_in_group(sized, position, "size", "_place", shard_rows).withColumnRenamed("size", "_size")
    found = placed.join(F.broadcast(_plan_table(df.sparkSession, shares)), "_size")
    share = F.element_at(F.filter("_shares", lambda s: s["begin"] <= F.col("_place")), -1)
    found = found.withColumn("_share", share)
    past = F.col("_place") - F.col("_share.begin")
    within = F.pmod(past, F.col("_share.each"))
    return (
        found.withColumn("size", F.col("_size"))
        .withColumn("block", F.col("_share.block") + F.floor(past / F.col("_share.each")))
        .withColumn("start", F.col("_share.used") + within * F.col("_size"))
        .drop("_size", "_place", "_shares", "_share")
    )


def pack_whole(df: DataFrame, position: str, ids: str, length: int, padded: bool = False) -> DataFrame:
    """(block, input_ids): every row whole in one block, its end marker behind it, longest first.

    A row too long for a block keeps its first ``length - 1`` ids and its end marker. With ``padded``
    all blocks have ``length`` ids. A null list of ids is an empty one.
    """
    cut = F.slice(F.coalesce(ids, F.array().cast("array<bigint>")), 1, length - 1)
    given = df.select(position, cut.alias("_ids")).withColumn("_n", F.size("_ids"))
    plan = whole_plan(given, position, "_n", length, 4 * ID_ROWS)
    ended = F.concat("_ids", F.array(F.lit(EOS).cast("bigint")))
    gathered = plan.groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("start", ended.alias("ids")))).alias("_rows")
    )
    packed = F.flatten(F.transform("_rows", lambda r: r["ids"]))
    return gathered.select("block", (_filled(packed, length) if padded else packed).alias("input_ids"))


def _filled(ids: Column, length: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(PAD).cast("bigint"), F.lit(length) - F.size(ids)))


def fill_rate(plan: DataFrame, length: int) -> DataFrame:
    """One row: blocks, tokens in them, and the share of their places that is filled."""
    totals = plan.agg(F.countDistinct("block").alias("n_blocks"), F.sum("size").alias("n_tokens"))
    return totals.withColumn("filled", F.col("n_tokens") / (F.col("n_blocks") * length))
