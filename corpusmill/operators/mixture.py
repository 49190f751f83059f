"""Filters, mapping and mixing of sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.hashing import SPACE, draw
from corpusmill.operators.ordering import SHARD_ROWS, position_in_group
from corpusmill.session import stage


def not_excluded(source: Column, excluded: list[str]) -> Column:
    """A null source is kept: it is in no list."""
    if not excluded:
        return F.lit(True)
    return ~F.coalesce(source.isin(excluded), F.lit(False))


def exclude_sources(df: DataFrame, excluded: list[str], column: str = "source") -> DataFrame:
    return df.where(not_excluded(F.col(column), excluded))


def exclude_listed(df: DataFrame, denied: DataFrame, column: str) -> DataFrame:
    """As ``exclude_sources`` with the list in a table; left to Spark's size check to broadcast."""
    return df.join(denied.select(column).distinct(), column, "left_anti")


def allow_listed(df: DataFrame, allowed: DataFrame, column: str) -> DataFrame:
    return df.join(allowed.select(column).distinct(), column, "left_semi")


def allow_values(df: DataFrame, allowed: list[str], column: str) -> DataFrame:
    return df.where(F.col(column).isin(allowed))


def has_two_messages(messages: Column) -> Column:
    return F.size(messages) == 2


def map_sources(
    df: DataFrame, source_map: dict[str, str], column: str = "source", target: str = "config"
) -> DataFrame:
    """Name each row's subset by its source in one pass; rows of unmapped sources are dropped.

    The map comes from the recipe, so it is small by nature and becomes a broadcast join.
    """
    if not source_map:
        return df.withColumn(target, F.lit(None).cast("string")).where(F.lit(False))
    mapping = _literal_table(df.sparkSession, [column, target], list(source_map.items()))
    return df.join(F.broadcast(mapping), column)


def concat(frames: list[DataFrame]) -> DataFrame:
    """All rows of all tables, duplicates included; a column missing somewhere is null there."""
    if not frames:
        raise ValueError("nothing to concatenate")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def weighted_mix(
    df: DataFrame, weights: dict[str, float], keys: list[str], seed: int, column: str = "source"
) -> DataFrame:
    """Each source in the proportion of its weight: 0.25 keeps a quarter of its rows, 2.5 repeats
    all twice and half of them once more. Sources without a weight are left out.

    ``copy`` numbers the repetitions of a row from 1.
    """
    rows = [
        (source, int(weight), int((weight - int(weight)) * SPACE))
        for source, weight in weights.items()
    ]
    table = _literal_table(df.sparkSession, [column, "_whole", "_part"], rows)
    extra = (draw(seed, *[F.col(k) for k in keys]) < F.col("_part")).cast("int")
    return (
        df.join(F.broadcast(table), column)
        .withColumn("_copies", F.col("_whole").cast("int") + extra)
        .where("_copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .drop("_whole", "_part", "_copies")
    )


def interleave(
    df: DataFrame,
    position: str,
    probabilities: dict[str, float],
    seed: int,
    column: str = "source",
    stop: str = "first",
    order: str = "order",
    block_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Rows of the sources in a drawn order, numbered from 0 by ``order``.

    Each place of the order draws a source by its probability and takes that source's next row, by the
    dense ``position``. With ``stop="first"`` the order ends when a source has given its last row; with
    ``"all"`` when every source has, and a source that is through starts again. Sources without a
    probability, and those without rows, take no part; what the others have is scaled up.

    A place's draw comes from its number alone. Draws are counted by blocks of ``block_rows`` places;
    the counts say where the order ends and which row of its source a place takes, so no window spans
    the order. What reaches the driver is a few numbers for each source.
    """
    if stop not in ("first", "all"):
        raise ValueError(f"stop is 'first' or 'all', not {stop!r}")
    spark = df.sparkSession
    wanted = [s for s, p in probabilities.items() if p > 0]
    rows = df.where(F.col(column).isin(wanted))
    sizes = {r[0]: r[1] for r in rows.groupBy(column).agg(F.count(F.lit(1))).collect()}
    drawn = {s: probabilities[s] for s in wanted if sizes.get(s)}
    if not drawn:
        return df.withColumn(order, F.lit(0).cast("bigint")).where(F.lit(False))

    def schedule(places: int) -> DataFrame:
        return _schedule(spark, places, drawn, seed, block_rows)

    ends = min if stop == "first" else max
    places = int(ends(sizes[s] * sum(drawn.values()) / p for s, p in drawn.items()) * 1.1) + 1000
    while True:
        counts = stage(schedule(places).groupBy("_block", "_source").agg(F.count(F.lit(1)).alias("_n")), "draws")
        totals = {r["_source"]: r["n"] for r in counts.groupBy("_source").agg(F.sum("_n").alias("n")).collect()}
        enough = [totals.get(s, 0) >= sizes[s] for s in drawn]
        if any(enough) if stop == "first" else all(enough):
            break
        places *= 2
    earlier = Window.partitionBy("_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_block", "_source").orderBy("_order")) - 1

    has = _literal_table(spark, ["_source", "_size"], [(s, sizes[s]) for s in drawn])
    last = offsets.join(F.broadcast(has), "_source").where(
        (F.col("_before") < F.col("_size")) & (F.col("_size") <= F.col("_before") + F.col("_n"))
    )
    last = last.select("_block", "_source", (F.col("_size") - F.col("_before") - 1).alias("_place"))
    last_draws = schedule(places).join(F.broadcast(last), ["_block", "_source"]).withColumn("_inside", inside)
    length = ends(r["_order"] for r in last_draws.where("_inside = _place").select("_order").collect()) + 1

    draws = schedule(length).withColumn("_inside", inside).join(offsets, ["_block", "_source"])
    draws = draws.join(F.broadcast(has), "_source").withColumn("_taken", F.col("_before") + F.col("_inside"))
    draws = draws.select(
        F.col("_source").alias(column),
        F.pmod("_taken", "_size").alias("_place"),
        F.floor(F.col("_taken") / F.col("_size")).alias("_turn"),
        F.col("_order").alias(order),
    )
    # a source's row is there once for each turn, so a small source that is drawn often is no hot key
    turns = [(s, -(-totals[s] // sizes[s])) for s in drawn if totals.get(s)]
    turns = F.broadcast(_literal_table(spark, [column, "_turns"], turns))
    placed = position_in_group(rows, position, column, "_place").join(turns, column)
    if stop == "all":
        again = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_turns").cast("bigint") - 1))
    else:
        again = F.lit(0).cast("bigint")
    placed = placed.withColumn("_turn", again).drop("_turns")
    return placed.join(draws, [column, "_place", "_turn"]).select(*df.columns, order)


def _schedule(
    spark: SparkSession, places: int, probabilities: dict[str, float], seed: int, block_rows: int
) -> DataFrame:
    """(_order, _block, _source): the source that each place draws."""
    total, reached, edges = sum(probabilities.values()), 0.0, []
    for name, p in probabilities.items():
        reached += p
        edges.append((name, int(reached / total * SPACE)))
    source = F.lit(edges[-1][0])
    for name, edge in reversed(edges[:-1]):
        source = F.when(F.col("_drawn") < edge, F.lit(name)).otherwise(source)
    drawn = spark.range(places).select(F.col("id").alias("_order"), draw(seed, F.col("id")).alias("_drawn"))
    return drawn.select("_order", F.floor(F.col("_order") / F.lit(block_rows)).alias("_block"), source.alias("_source"))


def _literal_table(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A table from the recipe, made in the JVM."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
