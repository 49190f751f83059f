"""Scores, accuracy, the bigram model and a caller's model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import scoring
from corpusmill.plans.evaluation import evaluate, evaluate_scores
from workload.inputs import OPTION_SCORES, PARTS, TOKEN, micros, option_scores, read_wide, vectors
from workload.questions import PROMPT, book_items
from workload.registry import case

RATE = "round(count(*) filter (is_correct) / count(*)::double * 1000000)::bigint"


@case(f"with {OPTION_SCORES} select item, dataset, target, pred, is_correct from preds")
def argmax_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = scoring.argmax_option(option_scores(spark, sf_dir))
    return chosen.withColumn("pred", F.col("pred").cast("bigint"))


@case(
    f"""with {OPTION_SCORES} select dataset, count(*) filter (is_correct) as correct,
    count(*) as total, {RATE} as accuracy_micro from preds group by dataset"""
)
def accuracy_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions = scoring.argmax_option(option_scores(spark, sf_dir))
    rates = scoring.accuracy_by_dataset(predictions)
    return rates.select("dataset", "correct", "total", micros(F.col("accuracy")).alias("accuracy_micro"))


@case(
    f"""with {OPTION_SCORES} select dataset, count(*) filter (is_correct) as correct,
    count(*) as total, {RATE} as accuracy_micro, grouping(dataset) = 1 as is_total
    from preds group by rollup (dataset)"""
)
def accuracy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions = scoring.argmax_option(option_scores(spark, sf_dir))
    rates = scoring.accuracy_with_total(predictions)
    rate = micros(F.col("accuracy")).alias("accuracy_micro")
    return rates.select("dataset", "correct", "total", rate, "is_total")


@case(
    f"""with {OPTION_SCORES}
    select case when dataset is null then 'accuracy' else 'accuracy_' || dataset end as metric,
           {RATE} as value_micro
    from preds group by rollup (dataset)"""
)
def metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = evaluate_scores(option_scores(spark, sf_dir))
    return metrics.select("metric", micros(F.col("value")).alias("value_micro"))


@case(
    f"""with {OPTION_SCORES}, loose as (
      select case when dataset <> 'ds0' then dataset end as dataset, is_correct from preds)
    select case when grouping(dataset) = 1 then 'accuracy'
                else 'accuracy_' || coalesce(dataset, 'null') end as metric, {RATE} as value_micro
    from loose group by rollup (dataset)"""
)
def metrics_without_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the items belong to no dataset; they are a group of their own, not the total."""
    scores = option_scores(spark, sf_dir)
    loose = scores.withColumn("dataset", F.when(F.col("dataset") != "ds0", F.col("dataset")))
    metrics = evaluate_scores(loose)
    return metrics.select("metric", micros(F.col("value")).alias("value_micro"))


@case(
    f"""with {OPTION_SCORES}, tops as (
      select item, dataset, target, max(score) as top from option_scores group by all),
    losses as (
      select t.dataset, top + ln(sum(exp(score - top)))
             - max(case when option_idx = t.target then score end) as loss
      from option_scores o join tops t using (item) group by t.item, t.dataset, top)
    select dataset, count(loss) as n, sum(round(loss * 1000000)::bigint)::bigint as loss_micro
    from losses group by dataset"""
)
def option_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = scoring.cross_entropy(F.col("logits"), F.col("target"))
    losses = vectors(spark, sf_dir).select("dataset", loss.alias("loss"))
    return losses.groupBy("dataset").agg(
        F.count("loss").alias("n"), F.sum(micros(F.col("loss"))).alias("loss_micro")
    )


BIGRAMS = f"""words as (select regexp_extract_all(text, '{TOKEN}') as t from documents),
    pairs as (
      select prev, cur, count(*) as n from (
        select unnest(t[1:len(t) - 1]) as prev, unnest(t[2:len(t)]) as cur
        from words where len(t) > 1) group by all),
    contexts as (select prev, sum(n) as n_prev from pairs group by prev),
    size as (select count(*) as v from (select prev from pairs union select cur from pairs))"""


@case(
    f"""with {BIGRAMS}
    select prev, cur, n, n_prev::bigint as n_prev,
           round(ln((n + 1)::double / (n_prev + v)::double) * 1000000)::bigint as logp
    from pairs join contexts using (prev), size"""
)
def bigram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.train_bigrams(read_wide(spark, sf_dir, "documents")).table()


CANDIDATE_SCORES = f"""cands as (
      select 'book_' || pos as item, p_brand as dataset, p_partkey % 4 as target, i as option_idx,
             regexp_extract_all({PROMPT} || ' ' || chr((65 + i)::integer), '{TOKEN}') as t
      from parts, range(4) r(i)),
    steps as (
      select item, dataset, target, option_idx, len(t) as n_tokens,
             unnest(t[1:len(t) - 1]) as prev, unnest(t[2:len(t)]) as cur from cands),
    scored as (
      select item, dataset, target, option_idx,
             sum(round(ln((coalesce(n, 0) + 1)::double / (coalesce(n_prev, 0) + v)::double) * 1000000)::bigint)
               * n_tokens::double / (n_tokens - 1) / 1000000 as score
      from steps left join pairs using (prev, cur) left join contexts using (prev), size
      group by item, dataset, target, option_idx, n_tokens)"""


@case(
    f"""with {PARTS}, {BIGRAMS}, {CANDIDATE_SCORES}
    select item, option_idx::integer as option_idx, round(score * 1000)::bigint as score_milli
    from scored"""
)
def score_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = scoring.train_bigrams(read_wide(spark, sf_dir, "documents"))
    scores = scoring.score_options(book_items(spark, sf_dir), ["item"], model)
    milli = F.round(F.col("score") * 1000).cast("bigint")
    return scores.select("item", "option_idx", milli.alias("score_milli"))


@case(
    f"""with {PARTS}, {BIGRAMS}, {CANDIDATE_SCORES}
    select item, option_idx::integer as option_idx, round(score * 1000)::bigint as score_milli
    from scored where item not in (select 'book_' || pos from parts where pos % 10 = 0)
    union all select 'book_' || pos, null, null from parts where pos % 10 = 0"""
)
def score_without_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some items have no options; they stay, without a score."""
    model = scoring.train_bigrams(read_wide(spark, sf_dir, "documents"))
    bare = F.substring_index("item", "_", -1).cast("bigint") % 10 == 0
    items = book_items(spark, sf_dir).withColumn(
        "options", F.when(bare, F.array().cast("array<string>")).otherwise(F.col("options"))
    )
    scores = scoring.score_options(items, ["item"], model)
    milli = F.round(F.col("score") * 1000).cast("bigint")
    return scores.select("item", "option_idx", milli.alias("score_milli"))


PREDICTED = """best as (select item, max(score) as score from scored group by item),
    preds as (
      select s.item, s.dataset, min(s.option_idx) = any_value(s.target) as is_correct
      from scored s join best b on b.item = s.item and b.score = s.score
      group by s.item, s.dataset)"""


@case(
    f"""with {PARTS}, {BIGRAMS}, {CANDIDATE_SCORES}, {PREDICTED}
    select case when dataset is null then 'accuracy' else 'accuracy_' || dataset end as metric,
           {RATE} as value_micro
    from preds group by rollup (dataset)"""
)
def evaluate_mcqa(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = scoring.train_bigrams(read_wide(spark, sf_dir, "documents"))
    metrics = evaluate(book_items(spark, sf_dir), model)
    return metrics.select("metric", micros(F.col("value")).alias("value_micro"))


@case(
    f"""with {PARTS} select 'book_' || pos as item, i::integer as option_idx,
    (65 + i)::double as score from parts, range(4) r(i)"""
)
def model_scored_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's model in the place of the built-in one: the code of the last character.

    It is defined in here so that it travels to the workers by value.
    """

    def make_model():
        import numpy as np

        return lambda texts: np.array([float(ord(t[-1])) for t in texts])

    candidates = scoring.option_candidates(book_items(spark, sf_dir))
    scored = scoring.score_with_model(candidates, make_model)
    return scored.select("item", "option_idx", "score")
