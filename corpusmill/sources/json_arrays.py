"""A JSON array in one file, read by many tasks.

The text reader cuts files at any byte and gives what lies between closing braces. Whether a piece
begins inside a string, and how deep it lies, depends on everything before it; so each piece is read
for both cases, and each stretch of the file becomes a function of the state in which it begins. These
functions are composed over the stretches, which are few, and then every piece knows its object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.session import stage

PLACE = ["file", "stretch"]


def scan_json_array_in_parts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of files that each hold one JSON array of objects, as ``multiLine`` reads them.

    A file is cut as Spark cuts any text (``spark.sql.files.maxPartitionBytes``). The files must be valid
    JSON in UTF-8; an object that doesn't fit the schema has nulls. Objects may be nested, and their
    strings may hold braces, brackets, quotes and escapes.
    """
    pieces = stage(_pieces(spark, path), "json-pieces")
    starts = _starts(pieces)
    known = pieces.join(starts, PLACE)
    inside = F.col("begins_inside")
    depth = F.col("begin_depth") + F.when(inside, F.col("depth_if_inside")).otherwise(F.col("depth_if_outside"))
    ends_outside = F.pmod(F.col("quotes") + inside.cast("int"), F.lit(2)) == 0
    closes = (ends_outside & (depth == 1) & ~F.col("is_last")).cast("bigint")  # of the array's own objects
    known = known.select(*PLACE, "place", "text", closes.alias("closes"))

    totals = known.groupBy(*PLACE).agg(F.sum("closes").alias("n"))
    earlier = Window.partitionBy("file").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*PLACE, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    before = Window.partitionBy(*PLACE).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    numbered = known.withColumn("inside", F.coalesce(F.sum("closes").over(before), F.lit(0))).join(offsets, PLACE)
    objects = numbered.groupBy("file", (F.col("before") + F.col("inside")).alias("number")).agg(
        F.sort_array(F.collect_list(F.struct("stretch", "place", "text"))).alias("parts"),
        F.max("closes").alias("whole"),
    )
    # what follows the last object of a file is no object
    text = F.array_join(F.transform(F.col("parts"), lambda p: F.concat(p["text"], F.lit("}"))), "")
    bare = F.regexp_replace(text, r"^[\s\[,\x{FEFF}]+", "")
    return objects.where("whole = 1").select(F.from_json(bare, schema).alias("row")).select("row.*")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, stretch, place, text, ...): what lies between closing braces, with the parity of the quotes
    up to its end and the change of depth up to its end, from the beginning of its stretch, for a stretch
    that begins outside of a string and for one that begins inside."""
    read = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("stretch"),
        (F.col("_metadata.file_block_start") + F.col("_metadata.file_block_length") >= F.col("_metadata.file_size")).alias("at_end"),
        F.monotonically_increasing_id().alias("place"),  # rises within a stretch
        F.col("value").alias("text"),
    )
    plain = F.regexp_replace("text", r"(?s)\\.", "")
    outside = F.regexp_replace(plain, r'"[^"]*(?:"|$)', "")
    after = F.regexp_replace(F.regexp_replace(plain, r'^[^"]*(?:"|$)', ""), r'"[^"]*(?:"|$)', "")
    given = read.select(
        "*",
        F.regexp_count(plain, F.lit('"')).alias("n_quotes"),
        _rise(outside).alias("rise_outside"),
        _rise(after).alias("rise_inside"),
    )
    order = Window.partitionBy(*PLACE).orderBy("place")
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    given = given.withColumns(
        {
            "quotes": F.sum("n_quotes").over(up_to),
            "quotes_before": F.coalesce(F.sum("n_quotes").over(earlier), F.lit(0)),
            "is_last": F.col("at_end") & F.lead("place").over(order).isNull(),
        }
    )

    def depth(begins_inside: int) -> Column:
        starts_inside = F.pmod(F.col("quotes_before") + begins_inside, F.lit(2)) == 1
        ends_inside = F.pmod(F.col("quotes") + begins_inside, F.lit(2)) == 1
        rise = F.when(starts_inside, F.col("rise_inside")).otherwise(F.col("rise_outside"))
        return F.sum(rise - (~ends_inside & ~F.col("is_last")).cast("int")).over(up_to)

    return given.select(
        *PLACE, "place", "text", "quotes", "is_last",
        depth(0).alias("depth_if_outside"), depth(1).alias("depth_if_inside"),
    )


def _rise(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\[{]")) - F.regexp_count(text, F.lit(r"\]"))


def _starts(pieces: DataFrame) -> DataFrame:
    """The state in which each stretch begins: inside of a string or not, and how deep."""
    last = F.struct("place", "quotes", "depth_if_outside", "depth_if_inside")
    ends = pieces.groupBy(*PLACE).agg(F.max(last).alias("end")).select(*PLACE, "end.*")
    earlier = Window.partitionBy("file").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.pmod(F.coalesce(F.sum("quotes").over(earlier), F.lit(0)), F.lit(2)) == 1
    ends = ends.withColumn("begins_inside", inside)
    rise = F.when(F.col("begins_inside"), F.col("depth_if_inside")).otherwise(F.col("depth_if_outside"))
    begin = F.coalesce(F.sum(rise).over(earlier), F.lit(0))
    return ends.select(*PLACE, "begins_inside", begin.alias("begin_depth"))
