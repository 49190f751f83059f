"""Vocabulary, token ids, truncation and padding, packing, batches."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import token_count, tokens
from corpusmill.operators.ordering import SHARD_ROWS, position_by_range, running_total
from corpusmill.operators.skew import MAX_BROADCAST_BYTES, lookup_join
from corpusmill.session import stage

PAD, UNKNOWN, EOS = 0, 1, 2
FIRST_ID = 3
BLOCK_BYTES = 4 << 20  # text that meets its share of the vocabulary at a time
ID_ROWS = 1 << 12  # rows of a shard that carry their ids along


def build_vocab(df: DataFrame, text: str = "text") -> DataFrame:
    """(token, n, token_id): ids rise as frequency falls, ties in hash order.

    Most tokens occur once; the order is cut into ranges of a bounded number of tokens, by the hash
    among those of equal frequency.
    """
    counts = (
        df.select(F.explode(tokens(F.col(text))).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("_hash", F.md5("token"))
    )
    ranked = position_by_range(counts, [F.col("n").desc(), F.col("_hash"), F.col("token")], "_rank")
    return ranked.select("token", "n", (F.col("_rank") + FIRST_ID).cast("bigint").alias("token_id"))


def encode(
    df: DataFrame,
    keys: list[str],
    texts: dict[str, str],
    vocab: DataFrame,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Token ids of one or more text columns: ``texts`` maps output column to input column.

    ``keys`` identify a row; the tokens of rows that share them are merged by place. Tokens outside
    the vocabulary become ``UNKNOWN``.

    The rows are dealt by their keys to blocks of about ``block_bytes``, whose number follows from the
    amount of text. Only the distinct tokens of each block are looked up, by ``lookup_join``; a block
    and its share of the vocabulary then meet in one task, which puts ids in the place of tokens. The
    texts move once. ``df`` is read for their size and for its keys as well: stage what is costly.
    """
    size = reduce(add, [F.coalesce(F.octet_length(c), F.lit(0)) for c in texts.values()]).cast("bigint")
    blocks = -(-(df.agg(F.sum(size).alias("n")).first()["n"] or 1) // block_bytes)
    block = F.pmod(F.xxhash64(*keys), F.lit(blocks))
    fields = [f"_text{i}" for i in range(len(texts))]
    dealt = df.select(*keys, *[F.col(c).alias(f) for f, c in zip(fields, texts.values())])
    dealt = dealt.repartition(*_parts(df.sparkSession, blocks), block).withColumn("_block", block)
    joined = [F.array_join(tokens(F.col(f)), " ").alias(f) for f in fields]
    rows = dealt.select("_block", *keys, *joined)

    words = F.explode(F.flatten(F.array(*[tokens(F.col(f)) for f in fields]))).alias("token")
    distinct = dealt.select("_block", words).distinct()
    # A token occurs once in a block, so none is hot enough for salts.
    found = lookup_join(distinct, vocab, ["token"], "n", "inner", max_broadcast_bytes, salts=1)
    known = found.select(F.col("_block").alias("_of"), "token", F.col("token_id").cast("bigint").alias("token_id"))
    kinds = [T.StructField(k, rows.schema[k].dataType) for k in keys]
    schema = T.StructType([*kinds, *[T.StructField(n, T.ArrayType(T.LongType())) for n in texts]])
    met = rows.groupBy("_block").cogroup(known.groupBy("_of"))
    encoded = met.applyInArrow(_placer(keys, list(texts)), schema)
    if df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        return encoded
    placed = [
        F.flatten(F.collect_list(F.transform(n, lambda x, i: F.struct(i.alias("pos"), x.alias("id"))))).alias(n)
        for n in texts
    ]
    merged = encoded.groupBy(*keys).agg(*placed)
    return merged.select(*keys, *[F.transform(F.sort_array(n), lambda t: t["id"]).alias(n) for n in texts])


def _parts(spark: SparkSession, blocks: int) -> list[int]:
    """A partition for each block, once there are more than cores: adaptive execution would make some
    tasks for each core of them, which grow with the input. Fewer than ``spark.sql.shuffle.partitions``
    would be dealt again."""
    if blocks <= spark.sparkContext.defaultParallelism:
        return []
    return [max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))]


def _placer(keys: list[str], names: list[str]) -> Callable:
    """Puts the ids of ``known`` in the place of the tokens of a block's rows."""
    unknown = UNKNOWN

    def place(rows: pa.Table, known: pa.Table) -> pa.Table:
        ids = known["token_id"].combine_chunks()
        columns = [rows[k] for k in keys]
        for i in range(len(names)):
            text = rows[f"_text{i}"].combine_chunks()
            split = pc.split_pattern(pc.if_else(pc.equal(text, ""), None, text), " ")
            ends = np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy(), dtype=np.int64)
            at = pc.index_in(split.flatten(), value_set=known["token"].combine_chunks().cast(text.type))
            values = pc.fill_null(ids.take(at), unknown)
            columns.append(pa.LargeListArray.from_arrays(np.append(0, ends), values).cast(pa.list_(pa.int64())))
        return pa.table(columns, names=[*keys, *names])

    return place


def truncate(ids: Column, length: int, side: str = "right") -> Column:
    """At most ``length`` ids, cutting at the given side."""
    if side == "right":
        return F.slice(ids, 1, length)
    start = F.greatest(F.size(ids) - length, F.lit(0)) + 1
    return F.slice(ids, start, F.lit(length))


def pad(ids: Column, length: int, side: str = "left", value: int = PAD) -> Column:
    filler = F.array_repeat(F.lit(value).cast("bigint"), _missing(ids, length))
    return F.concat(filler, ids) if side == "left" else F.concat(ids, filler)


def attention_mask(ids: Column, length: int, side: str = "left") -> Column:
    """1 for each id and 0 for each place that ``pad`` fills."""
    zeros = F.array_repeat(F.lit(0).cast("bigint"), _missing(ids, length))
    ones = F.array_repeat(F.lit(1).cast("bigint"), F.size(ids))
    return F.concat(zeros, ones) if side == "left" else F.concat(ones, zeros)


def _missing(ids: Column, length: int) -> Column:
    return F.greatest(F.lit(length) - F.size(ids), F.lit(0))


def encode_pairs(
    df: DataFrame,
    keys: list[str],
    vocab: DataFrame,
    length: int,
    question: str = "input",
    answer: str = "output",
) -> DataFrame:
    """Instruction and response texts -> padded ``input_ids``, its mask, and padded ``labels``."""
    given = stage(df.select(*keys, question, answer), "pairs-to-encode")
    ids = encode(given, keys, {"_in": question, "_out": answer}, vocab)
    cut_in, cut_out = truncate(F.col("_in"), length), truncate(F.col("_out"), length)
    return ids.select(
        *keys,
        pad(cut_in, length).alias("input_ids"),
        attention_mask(cut_in, length).alias("attention_mask"),
        pad(cut_out, length).alias("labels"),
    )


def truncation_audit(df: DataFrame, text: str, source: str, length: int) -> DataFrame:
    """Per source: rows, rows whose end marker would be cut off, and the token counts.

    Rows are counted by length first, so what is kept for the median is one number for each length.
    """
    counted = df.select(source, token_count(F.col(text)).alias("n_tokens"))
    lengths = counted.groupBy(source, "n_tokens").agg(F.count(F.lit(1)).alias("_n"))
    return lengths.groupBy(source).agg(
        F.sum("_n").alias("n"),
        F.sum(F.when(F.col("n_tokens") + 1 > length, F.col("_n")).otherwise(0)).alias("n_truncated"),
        F.percentile("n_tokens", F.lit(0.5), F.col("_n")).alias("median_tokens"),
        F.max("n_tokens").alias("max_tokens"),
    )


def pack_plan(
    df: DataFrame, position: str, n_tokens: str, length: int, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """Where each row lands when all rows, one end marker after each, fill blocks of ``length``.

    Adds ``start`` (tokens before the row), ``first_block``, ``last_block`` and ``crosses``. One task
    orders ``shard_rows`` rows with all their columns.
    """
    sized = df.withColumn("_size", F.col(n_tokens) + 1)
    placed = running_total(sized, position, "_size", "start", shard_rows)
    last = F.floor((F.col("start") + F.col("_size") - 1) / F.lit(length))
    return (
        placed.withColumn("first_block", F.floor(F.col("start") / F.lit(length)))
        .withColumn("last_block", last)
        .withColumn("crosses", F.col("last_block") > F.col("first_block"))
        .drop("_size")
    )


def pack(df: DataFrame, position: str, ids: str, length: int) -> DataFrame:
    """(block, input_ids): blocks of exactly ``length`` ids, the last one maybe shorter.

    A row is cut into its share of each block; a block gathers at most ``length`` ids.
    """
    sized = df.select(position, F.col(ids).alias("_ids")).withColumn("_n", F.size("_ids"))
    plan = pack_plan(sized, position, "_n", length, ID_ROWS)
    ended = F.concat(F.col("_ids"), F.array(F.lit(EOS).cast("bigint")))
    cut = plan.withColumn("_ids", ended).withColumn(
        "block", F.explode(F.sequence("first_block", "last_block"))
    )
    begin = F.greatest(F.col("block") * length - F.col("start"), F.lit(0)).cast("int")
    end = F.least((F.col("block") + 1) * length - F.col("start"), F.size("_ids")).cast("int")
    shares = cut.select("block", "start", F.slice("_ids", begin + 1, end - begin).alias("share"))
    return (
        shares.groupBy("block")
        .agg(F.sort_array(F.collect_list(F.struct("start", "share"))).alias("_shares"))
        .select("block", F.flatten(F.transform("_shares", lambda s: s["share"])).alias("input_ids"))
    )


def batches(df: DataFrame, position: str, columns: list[str], size: int) -> DataFrame:
    """Rows in groups of ``size`` by dense position, each group as parallel lists."""
    grouped = (
        df.withColumn("batch", F.floor(F.col(position) / F.lit(size)))
        .groupBy("batch")
        .agg(F.sort_array(F.collect_list(F.struct(F.col(position).alias("_place"), *columns))).alias("_rows"))
    )
    return grouped.select("batch", *[_field("_rows", c).alias(c) for c in columns])


def _field(rows: str, name: str) -> Column:
    return F.transform(rows, lambda r: r[name])
