"""The shapes that the operators read, derived from the given tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.hashing import SPACE
from corpusmill.operators.adapters import POSITION, Origin
from corpusmill.sources.tables import with_row_position

EOS = "<|end|>"
START = "<|start|>"
SOURCE_MAP = {"src0": "chat", "src1": "math", "src2": "code", "src3": "safety"}
EXCLUDED = ["src3"]
SUBJECTS = ["economy", "small"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_wide(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """``read`` for work that is heavy per row: the small test files hold one row group each, which
    one core would read alone, so their rows are dealt out."""
    return read(spark, sf_dir, table).repartition(shares(spark, sf_dir, table))


def shares(spark: SparkSession, sf_dir: str, table: str) -> int:
    """Into how many parts to deal out a table's rows: a core each, and more as the table grows, so
    that what one task holds doesn't grow with it."""
    cores = spark.sparkContext.defaultParallelism
    return max(cores, 4 * read(spark, sf_dir, table).rdd.getNumPartitions())


def joined(array: Column) -> Column:
    return F.array_join(array.cast("array<string>"), "|")


def micros(value: Column) -> Column:
    return F.round(value * 1000000).cast("bigint")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per message; every eighth conversation has no source."""
    number = F.col("conv_id") % 8
    return read(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        "role",
        F.col("text").alias("content"),
        F.when(number != 7, F.concat(F.lit("src"), number.cast("string"))).alias("source"),
    )


TURNS = """turns as (
  select conv_id, turn, role, text as content,
         case when conv_id % 8 <> 7 then 'src' || (conv_id % 8) end as source
  from conversations)"""

LENGTHS = (
    TURNS
    + """, lengths as (
  select conv_id, source, count(*) as n_messages from turns group by all)"""
)

PARTS = """parts as (
  select *, row_number() over (order by p_partkey) - 1 as pos,
         [p_name, p_brand, p_type, 'size ' || p_size] as choices,
         ['A', 'B', 'C', 'D', 'E'] as letters
  from part)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_row_position(read(spark, sf_dir, "part"), POSITION)


def _size_text() -> Column:
    return F.concat(F.lit("size "), F.col("p_size").cast("string"))


def _choices() -> Column:
    return F.array("p_name", "p_brand", "p_type", _size_text())


def subject_table(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """Index 4 is outside the letters."""
    return parts(spark, sf_dir).select(
        POSITION,
        F.lower("p_type").alias(label),
        F.col("p_name").alias("question"),
        _choices().alias("choices"),
        (F.col("p_partkey") % 5).cast("int").alias("answer"),
    )


def arc_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some answer keys are digits."""
    key = F.col("p_partkey")
    letter = F.char((key % 4) + 65)
    return parts(spark, sf_dir).select(
        POSITION,
        key.cast("string").alias("id"),
        F.col("p_name").alias("question"),
        F.struct(_choices().alias("text")).alias("choices"),
        F.when(key % 6 == 5, F.lit("1")).otherwise(letter).alias("answerKey"),
    )


ARC_KEY = "case when p_partkey % 6 = 5 then '1' else letters[(p_partkey % 4) + 1] end"


def science_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    natural = F.col("p_size") % 2 == 0
    return parts(spark, sf_dir).select(
        POSITION,
        F.when(key % 3 == 0, F.lit("img")).alias("image"),
        F.when(natural, F.lit("natural science")).otherwise(F.lit("other")).alias("subject"),
        F.when(key % 5 == 0, F.lit("open")).otherwise(F.lit("closed choice")).alias("task"),
        F.col("p_name").alias("question"),
        _choices().alias("choices"),
        (key % 5).cast("int").alias("answer"),
    )


def math_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choice d holds a number with a comma, which ends it early."""
    packed = F.concat(
        F.lit("a ) "),
        F.col("p_size").cast("string"),
        F.lit(" , b ) "),
        F.col("p_brand"),
        F.lit(" . , c ) "),
        F.col("p_type"),
        F.lit(" , d ) 1,000 , e ) none"),
    )
    return parts(spark, sf_dir).select(
        POSITION,
        F.col("p_name").alias("Problem"),
        packed.alias("options"),
        F.char((F.col("p_partkey") % 5) + 97).alias("correct"),
        F.col("p_brand").alias("Rationale"),
    )


MATH_CHOICES = """list_transform(
    regexp_extract_all('a ) ' || p_size || ' , b ) ' || p_brand || ' . , c ) ' || p_type
      || ' , d ) 1,000 , e ) none', '[a-e]\\s*\\)\\s*([^,]+)', 1),
    lambda c: replace(trim(c), ' .', '.'))"""


def openbook_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select(
        POSITION,
        F.col("p_name").alias("question_stem"),
        F.struct(_choices().alias("text")).alias("choices"),
        F.char((F.col("p_partkey") % 4) + 65).alias("answerKey"),
        F.col("p_brand").alias("fact1"),
    )


def sciq_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select(
        POSITION,
        F.concat(F.lit("which "), F.col("p_name")).alias("question"),
        F.col("p_name").alias("distractor1"),
        F.col("p_brand").alias("distractor2"),
        F.col("p_type").alias("distractor3"),
        _size_text().alias("correct_answer"),
        F.col("p_brand").alias("support"),
    )


def medical_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option numbers run from -1 to 4, so some are outside; some explanations are missing."""
    key = F.col("p_partkey")
    single = F.col("p_size") % 2 == 0
    return parts(spark, sf_dir).select(
        POSITION,
        F.col("p_name").alias("question"),
        F.col("p_name").alias("opa"),
        F.col("p_brand").alias("opb"),
        F.col("p_type").alias("opc"),
        _size_text().alias("opd"),
        ((key % 6) - 1).cast("int").alias("cop"),
        F.when(single, F.lit("single")).otherwise(F.lit("multi")).alias("choice_type"),
        F.when(key % 4 != 0, F.col("p_brand")).alias("exp"),
    )


def origin(name: str, subset: str, split: str = "train") -> Origin:
    return Origin(name, subset, split, SUBJECTS)


def option_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score per vector element, as long rows."""
    return vectors(spark, sf_dir).select(
        "item", "dataset", "target", F.posexplode("logits").alias("option_idx", "score")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item"),
        F.concat(F.lit("ds"), (F.col("vec_id") % 3).cast("string")).alias("dataset"),
        (F.col("label") % 64).cast("int").alias("target"),
        F.col("embedding").cast("array<double>").alias("logits"),
    )


OPTION_SCORES = """option_scores as (
  select vec_id as item, 'ds' || (vec_id % 3) as dataset, label % 64 as target, i as option_idx,
         embedding[i + 1]::double as score
  from embeddings, range(64) r(i))
, best as (
  select item, any_value(dataset) as dataset, any_value(target) as target,
         arg_max(option_idx, score * 1.0) as top, max(score) as score
  from option_scores group by item)
, preds as (
  select b.item, b.dataset, b.target, min(o.option_idx) as pred,
         min(o.option_idx) = b.target as is_correct
  from best b join option_scores o on o.item = b.item and o.score = b.score
  group by b.item, b.dataset, b.target)"""

TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s\p{Z}]"


def draw_sql(expression: str, seed: int | str = 42) -> str:
    """The 32-bit draw of ``seed:key`` as SQL."""
    return f"cast('0x' || substr(md5('{seed}:' || {expression}), 1, 8) as bigint)"


def chosen_sql(fraction: float, expression: str, seed: int | str = 42) -> str:
    return f"{draw_sql(expression, seed)} < {int(fraction * SPACE)}"
