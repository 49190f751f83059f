"""Scoring options, choosing one, and accuracy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import adjacent_pairs, tokens
from corpusmill.operators.langid import SCALE, log_share
from corpusmill.operators.skew import MAX_BROADCAST_BYTES, lookup_join
from corpusmill.session import stage

ITEM = ["item", "dataset", "target"]


def option_candidates(items: DataFrame) -> DataFrame:
    """One row per option with ``candidate``, the prompt followed by the option.

    An item without options keeps one row with none of the three.
    """
    others = [c for c in items.columns if c not in ("prompt", "options")]
    exploded = items.select(
        *others, "prompt", F.posexplode_outer("options").alias("option_idx", "option")
    )
    return exploded.select(
        *others, "option_idx", "option", F.concat("prompt", "option").alias("candidate")
    )


def score_with_model(
    candidates: DataFrame,
    make_predict_fn: Callable,
    text: str = "candidate",
    batch_size: int = 64,
    max_characters: int | None = None,
) -> DataFrame:
    """Adds ``score`` from a caller's model, loaded once per Python worker and fed in batches.

    A null text has no score. ``max_characters``, off by default, cuts texts before the model sees
    them, for models with a limit of their own; the end is kept, where the option stands.
    """
    predict = predict_batch_udf(
        make_predict_fn, return_type=T.DoubleType(), batch_size=batch_size
    )
    given = F.coalesce(F.col(text), F.lit(""))
    if max_characters is not None:
        given = F.right(given, F.lit(max_characters))
    return candidates.withColumn("_score", predict(given)).select(
        *[F.col(c) for c in candidates.columns if c != "score"],
        F.when(F.col(text).isNotNull(), F.col("_score")).alias("score"),
    )


@dataclass(frozen=True)
class BigramModel:
    """Counts of adjacent tokens, staged, which price pairs with add-one smoothing.

    ``pairs`` has (prev, cur, n), where a row without ``cur`` counts the texts that end in ``prev``;
    ``contexts`` has (prev, n_prev) for every token, null for one that never stands before another.
    """

    pairs: DataFrame
    contexts: DataFrame
    vocabulary: int

    def unseen(self) -> Column:
        """Price of a pair whose first token was never seen before another."""
        return log_share(F.lit(1), F.lit(max(self.vocabulary, 1)))

    def price(self, n: Column, n_prev: Column) -> Column:
        return log_share(n + 1, n_prev + self.vocabulary)

    def seen(self) -> DataFrame:
        """(prev, cur, n) for all pairs seen."""
        return self.pairs.where("cur is not null")

    def table(self) -> DataFrame:
        """(prev, cur, n, n_prev, logp) for all pairs seen."""
        whole = self.contexts.where("n_prev is not null").hint("shuffle_hash")
        logp = self.price(F.col("n"), F.col("n_prev")).alias("logp")
        return self.seen().join(whole, "prev").select("prev", "cur", "n", "n_prev", logp)


def train_bigrams(df: DataFrame, text: str = "text") -> BigramModel:
    """Counts the pairs once. Each text of two tokens or more adds its last token with no other behind
    it, so that every token is the first of some row and the vocabulary follows from the contexts."""
    split = df.select(tokens(F.col(text)).alias("t"))
    found = split.select(F.inline(F.when(F.size("t") > 1, adjacent_pairs(F.col("t"), ended=True))))
    pairs = stage(found.groupBy("prev", "cur").agg(F.count(F.lit(1)).alias("n")), "pairs")
    before = F.sum(F.when(F.col("cur").isNotNull(), F.col("n")))
    contexts = stage(pairs.groupBy("prev").agg(before.alias("n_prev")), "contexts")
    return BigramModel(pairs, contexts, contexts.count())


def score_options(
    items: DataFrame,
    keys: list[str],
    model: BigramModel,
    length_scale: str = "reference",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """(keys, option_idx, score) for every option of every item under the bigram model.

    The tokens of a candidate are those of the prompt and then those of the option, so the prompt
    is scored once and each option adds its own pairs. ``reference`` scales the mean loss by the
    number of tokens, ``sum`` by the number of predictions. An item without options keeps one row
    without option and score.

    A few pairs (the prompt's header) occur in every item. Needed pairs are counted first, priced
    once each, and that small result is joined back by ``lookup_join``.
    """
    rows = items.select(
        *keys, tokens(F.col("prompt")).alias("_said"), F.transform("options", tokens).alias("_more")
    )
    segments = rows.select(*keys, F.inline(_segments(F.col("_said"), F.col("_more"))))
    long = segments.select(*keys, "option_idx", "n_tokens", F.explode_outer("pairs").alias("pair"))
    long = long.select(*keys, "option_idx", "n_tokens", "pair.prev", "pair.cur")

    needed = long.where("prev is not null").groupBy("prev", "cur").agg(F.count(F.lit(1)).alias("heat"))
    needed = stage(needed, "needed-pairs")
    seen = model.seen().join(needed.select("prev", "cur"), ["prev", "cur"])
    whole = model.contexts.where("n_prev is not null")
    logp = model.price(F.coalesce("n", F.lit(0)), F.col("n_prev"))
    priced = (
        needed.join(seen, ["prev", "cur"], "left")
        .join(whole, "prev", "left")
        .select("prev", "cur", "heat", F.coalesce(logp, model.unseen()).alias("logp"))
    )
    summed = (
        lookup_join(long, stage(priced, "priced-pairs"), ["prev", "cur"], "heat", "left", max_broadcast_bytes)
        .groupBy(*keys, "option_idx", "n_tokens")
        .agg(F.coalesce(F.sum("logp"), F.lit(0)).alias("logp"), F.count("prev").alias("n_pairs"))
    )
    part = F.struct("option_idx", "n_tokens", "logp", "n_pairs")
    gathered = summed.groupBy(*keys).agg(F.collect_list(part).alias("_parts"))
    base = F.get(F.filter("_parts", lambda x: x["option_idx"] < 0), F.lit(0))
    options = F.filter("_parts", lambda x: x["option_idx"] >= 0)
    flat = gathered.select(*keys, base.alias("_base"), F.inline_outer(options))
    total = F.col("logp") + F.col("_base.logp")
    n_tokens = F.col("n_tokens") + F.col("_base.n_tokens")
    n_pairs = F.col("n_pairs") + F.col("_base.n_pairs")
    scale = n_tokens if length_scale == "reference" else n_pairs
    score = F.when(n_pairs > 0, (total * scale).cast("double") / n_pairs).otherwise(
        F.when(F.col("option_idx").isNotNull(), F.lit(0.0))
    )
    return flat.select(*keys, "option_idx", (score / F.lit(float(SCALE))).alias("score"))


def _segments(prompt: Column, options: Column) -> Column:
    """The prompt's tokens as option -1, then each option's with the prompt's last in front."""
    last = F.slice(prompt, F.greatest(F.size(prompt), F.lit(1)), F.lit(1))
    whole = F.struct(
        F.lit(-1).alias("option_idx"),
        F.size(prompt).alias("n_tokens"),
        adjacent_pairs(prompt).alias("pairs"),
    )
    parts = F.transform(
        options,
        lambda o, i: F.struct(
            i.alias("option_idx"),
            F.size(o).alias("n_tokens"),
            adjacent_pairs(F.concat(last, o)).alias("pairs"),
        ),
    )
    return F.concat(F.array(whole), F.coalesce(parts, F.slice(F.array(whole), 1, 0)))


def argmax_option(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The best option per item; of equal scores the lowest index wins.

    One aggregate gathers an item's options, a few pairs of numbers, and the best is found among
    them, so the scores are computed once. An item without options, or without scores, has no
    prediction and counts as wrong.
    """
    keys = ITEM if keys is None else keys
    option = F.struct("score", (-F.col("option_idx")).alias("turned"))
    scored = F.filter(F.collect_list(option), lambda o: o["score"].isNotNull())
    chosen = scores.groupBy(*keys).agg((-F.array_max(scored)["turned"]).alias("pred"))
    correct = F.coalesce(F.col("pred") == F.col("target"), F.lit(False))
    return chosen.withColumn("is_correct", correct)


def accuracy_by_dataset(predictions: DataFrame) -> DataFrame:
    counts = predictions.groupBy("dataset").agg(
        F.count_if("is_correct").alias("correct"), F.count(F.lit(1)).alias("total")
    )
    return counts.withColumn("accuracy", F.col("correct") / F.col("total"))


def accuracy_with_total(predictions: DataFrame) -> DataFrame:
    """Per dataset and over all, marked by ``is_total``; 0.0 over all when nothing was evaluated.

    The total adds up the per-dataset counts, whose exchange both branches share, so the predictions
    are computed once.
    """
    per_dataset = accuracy_by_dataset(predictions)
    overall = per_dataset.agg(
        F.coalesce(F.sum("correct"), F.lit(0)).alias("correct"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
    )
    share = F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(F.lit(0.0))
    return per_dataset.withColumn("is_total", F.lit(False)).unionByName(
        overall.select(
            F.lit(None).cast("string").alias("dataset"),
            "correct",
            "total",
            share.alias("accuracy"),
            F.lit(True).alias("is_total"),
        )
    )


def metrics_long(accuracies: DataFrame) -> DataFrame:
    """(metric, value): ``accuracy`` over all and ``accuracy_<dataset>``, with ``null`` for items
    without a dataset."""
    name = F.when(F.col("is_total"), F.lit("accuracy")).otherwise(
        F.concat(F.lit("accuracy_"), F.coalesce("dataset", F.lit("null")))
    )
    return accuracies.select(name.alias("metric"), F.col("accuracy").alias("value"))


def cross_entropy(logits: Column, target: Column) -> Column:
    """``-log softmax(logits)[target]``, stable; null when the target is no option."""
    values = F.transform(logits, lambda x: x.cast("double"))
    top = F.array_max(values)
    spread = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return top + F.ln(spread) - F.get(values, target)


def options_to_logits(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Long (item, option_idx, score) rows -> one ``logits`` array per item, 26 options at most."""
    ordered = F.sort_array(F.collect_list(F.struct("option_idx", "score")))
    return scores.groupBy(*keys).agg(F.transform(ordered, lambda s: s["score"]).alias("logits"))
