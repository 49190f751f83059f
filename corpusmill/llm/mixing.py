"""Mixing sources to target weights.

The words of each source are totalled, the budget is shared out by weight, and each document is
emitted floor(rate) times, plus one seeded Bernoulli copy with the fraction as its probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.hashing import hex_prefix, seeded_md5
from corpusmill.llm.common import packed, ranked, table, unused, word_count
from corpusmill.operators.skew import lookup_join
from corpusmill.session import stage

WEIGHTS = (5, 2, 1)  # by the source's place in code-point order, repeating
SHARE = 1.5  # of all words
MOST = 2  # times its source's words, the most that a target may be
SEED = "mix"
DIGITS = 13  # hex digits of a draw: 52 bits, which a double holds exactly


def source_targets(
    sizes: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """One row per source (``source, n, source_size, target``) from rows of (source, size).

    A null source is a source of its own, last in the order. Sources that would pass ``most``
    times their size stop there and their excess is shared by weight among the others, round by
    round until none is above; a round is one aggregate over the staged table of sources. With no
    words at all, every target is 0.
    """
    totals = sizes.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").cast("bigint").alias("source_size")
    )
    placed = ranked(totals, [F.col("source").asc_nulls_last()], "place", "mix-places")
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")
    )
    placed = stage(placed.withColumn("weight", weight), "mix-sources")
    limit = F.col("source_size") * F.lit(float(most))
    level, stopped = 0.0, -1
    while True:
        above = limit < F.lit(level) * F.col("weight")
        row = placed.agg(
            F.sum("source_size").alias("total"),
            F.count_if(above).alias("stopped"),
            F.sum(F.when(above, limit).otherwise(0.0)).alias("taken"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if row["total"] is None or row["stopped"] == stopped or not row["weight"]:
            break
        stopped = row["stopped"]
        level = (row["total"] * share - row["taken"]) / row["weight"]
    target = F.least(limit, F.lit(level) * F.col("weight"))
    return placed.select("source", "n", "source_size", target.alias("target"))


def with_copies(docs: DataFrame, seed: str = SEED, **shares) -> DataFrame:
    """``docs`` plus ``size``, ``source_size``, ``target`` and ``copies``, the number of times that the
    mix takes the document; columns of these names are replaced, others stay whatever their names.

    ``docs`` has doc_id, text, source. A null text has 0 words; a document without words has
    whatever copies its source's rate gives. Rows with the same doc_id share their draw; a row
    without one is drawn by its text.
    """
    sized = docs.drop("source_size", "target", "copies").withColumn("size", word_count(F.col("text")))
    targets = source_targets(sized.select("source", "size"), **shares)
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    of, heat = unused(sized, "_source"), unused(sized, "n")
    looked = lookup_join(
        sized.withColumn(of, key),
        targets.withColumn(of, key).drop("source").withColumnRenamed("n", heat),
        [of],
        heat,
    ).drop(of)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    drawn = hex_prefix(seeded_md5(seed, _drawn_by()), DIGITS).cast("double") / float(1 << 4 * DIGITS)
    extra = (drawn < rate - F.floor(rate)).cast("bigint")
    return looked.withColumn("copies", F.floor(rate) + extra)


def _drawn_by() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit(""))))


def mix(docs: DataFrame, seed: str = SEED, **shares) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the mix takes it, same columns."""
    given, row = packed(docs, "doc_id", "text", "source")
    many = with_copies(given, seed, **shares).where("copies > 0")
    again = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return many.select(row, again.alias("copy")).select(f"{row}.*")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return with_copies(docs).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


SQL = """
with sized as (
  select doc_id, text, source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size
  from documents),
sources as (
  select source, sum(size)::bigint as source_size,
         [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight
  from sized group by source),
ordered as (
  select *, 2.0::double * source_size as cap,
         coalesce(sum(2.0::double * source_size) over earlier, 0) as taken,
         sum(weight) over later as rest,
         1.5::double * sum(source_size) over () as budget
  from sources
  window earlier as (order by 2.0::double * source_size / weight, source nulls last
                     rows between unbounded preceding and 1 preceding),
         later as (order by 2.0::double * source_size / weight, source nulls last
                   rows between current row and unbounded following)),
level as (
  select (budget - taken) / rest as level from ordered
  where cap >= (budget - taken) / rest * weight
  order by 2.0::double * source_size / weight, source nulls last limit 1),
targets as (select source, source_size, least(cap, level * weight) as target from ordered, level),
rates as (
  select doc_id, size, t.source_size, target,
         case when t.source_size > 0 then target / t.source_size else 0 end as rate,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, 'text:' || coalesce(text, ''))), 1, 13))::bigint / 4503599627370496.0::double as drawn
  from sized s join targets t on s.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (size * (floor(rate) + (drawn < rate - floor(rate))::int))::bigint as taken
from rates"""
