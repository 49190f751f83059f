"""Vocabulary, encoding, truncation, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import chat
from corpusmill.functions.constants import MAX_TOKENS, PAIR_MAX_TOKENS
from corpusmill.functions.text import token_count
from corpusmill.operators import conversations, packing, tokens
from corpusmill.session import stage
from corpusmill.sources.tables import with_row_position
from workload.inputs import EOS, START, TOKEN, TURNS, joined, read, read_wide, turns
from workload.registry import case

VOCAB = f"""words as (
      select doc_id, regexp_extract_all(text, '{TOKEN}') as t from documents),
    counts as (
      select token, count(*) as n from (select unnest(t) as token from words) group by token),
    vocab as (
      select token, n, row_number() over (order by n desc, md5(token), token) + 2 as token_id
      from counts)"""

ENCODED = """long as (
      select doc_id, unnest(t) as token, generate_subscripts(t, 1) as pos from words),
    encoded as (
      select doc_id, list(token_id order by pos) as ids
      from long join vocab using (token) group by doc_id),
    all_ids as (
      select doc_id, coalesce(ids, []) as ids from documents left join encoded using (doc_id))"""


def _vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counting tokens moves few bytes: texts in as many files as cores are counted where they lie."""
    documents = read(spark, sf_dir, "documents")
    if len(documents.inputFiles()) < spark.sparkContext.defaultParallelism:
        documents = read_wide(spark, sf_dir, "documents")
    return stage(tokens.build_vocab(documents), "vocab")


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = _vocab(spark, sf_dir)
    return tokens.encode(read(spark, sf_dir, "documents"), ["doc_id"], {"ids": "text"}, vocab)


@case(f"with {VOCAB} select token, n, token_id from vocab")
def build_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.build_vocab(read_wide(spark, sf_dir, "documents"))


@case(f"with {VOCAB}, {ENCODED} select doc_id, array_to_string(ids, '|') as ids from all_ids")
def encode_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(spark, sf_dir).select("doc_id", joined(F.col("ids")).alias("ids"))


@case(
    f"""with {VOCAB}, {ENCODED}, cut as (
      select doc_id, ids[1:{MAX_TOKENS}] as head,
             ids[greatest(len(ids) - {MAX_TOKENS} + 1, 1):len(ids)] as tail, len(ids) as n from all_ids)
    select doc_id,
           array_to_string(list_concat(list_transform(range(greatest({MAX_TOKENS} - n, 0)), lambda i: 0), head), '|') as left_padded,
           array_to_string(list_concat(tail, list_transform(range(greatest({MAX_TOKENS} - n, 0)), lambda i: 0)), '|') as right_padded,
           array_to_string(list_transform(range({MAX_TOKENS}), lambda i: case when i < {MAX_TOKENS} - n then 0 else 1 end), '|') as mask
    from cut"""
)
def truncate_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.col("ids")
    head, tail = tokens.truncate(ids, MAX_TOKENS), tokens.truncate(ids, MAX_TOKENS, "left")
    return _encoded(spark, sf_dir).select(
        "doc_id",
        joined(tokens.pad(head, MAX_TOKENS, "left")).alias("left_padded"),
        joined(tokens.pad(tail, MAX_TOKENS, "right")).alias("right_padded"),
        joined(tokens.attention_mask(head, MAX_TOKENS, "left")).alias("mask"),
    )


PAIR_SIDES = ", ".join(
    f"""long_{role} as (
      select conv_id, unnest(t) as token, generate_subscripts(t, 1) as pos from (
        select conv_id, regexp_extract_all(coalesce(
          arg_min(content, turn) filter (role = '{role}'), ''), '{TOKEN}') as t
        from turns group by conv_id)),
    ids_{role} as (
      select conv_id, list(coalesce(token_id, 1) order by pos)[1:{PAIR_MAX_TOKENS}] as ids
      from long_{role} left join vocab using (token) group by conv_id)"""
    for role in ("user", "assistant")
)
PADDED = (
    f"array_to_string(list_concat(list_transform(range({PAIR_MAX_TOKENS} - len({{0}})), "
    "lambda i: 0), {0}), '|')"
)


@case(
    f"""with {TURNS}, {VOCAB}, {PAIR_SIDES}, both_sides as (
      select conv_id, coalesce(u.ids, []) as u, coalesce(a.ids, []) as a
      from (select distinct conv_id from turns) left join ids_user u using (conv_id)
      left join ids_assistant a using (conv_id))
    select conv_id, {PADDED.format('u')} as input_ids, {PADDED.format('a')} as labels,
           len(u)::bigint as n_attended
    from both_sides"""
)
def encode_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = conversations.first_contents(
        turns(spark, sf_dir), ["conv_id"], {"input": "user", "output": "assistant"}
    )
    encoded = tokens.encode_pairs(pairs, ["conv_id"], _vocab(spark, sf_dir), PAIR_MAX_TOKENS)
    attended = F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return encoded.select(
        "conv_id",
        joined(F.col("input_ids")).alias("input_ids"),
        joined(F.col("labels")).alias("labels"),
        attended.alias("n_attended"),
    )


@case(
    f"""with t as (
      select source, len(regexp_extract_all(text, '{TOKEN}')) as n_tokens from documents)
    select source, count(*) as n, count(*) filter (n_tokens + 1 > {MAX_TOKENS}) as n_truncated,
           quantile_cont(n_tokens::double, 0.5) as median_tokens, max(n_tokens)::bigint as max_tokens
    from t group by source"""
)
def truncation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.truncation_audit(read_wide(spark, sf_dir, "documents"), "text", "source", MAX_TOKENS)


@case(
    f"""with {VOCAB}, {ENCODED}, flat as (
      select doc_id, unnest(list_append(ids, 2)) as id,
             generate_subscripts(list_append(ids, 2), 1) as pos from all_ids),
    placed as (
      select id, row_number() over (order by doc_id, pos) - 1 as place from flat)
    select (place // {MAX_TOKENS})::bigint as block, count(*) as n,
           string_agg(id::varchar, '|' order by place) as ids
    from placed group by 1"""
)
def packed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded, ended and packed into blocks of the maximum length."""
    positions = with_row_position(read(spark, sf_dir, "documents").select("doc_id", "text"))
    vocab = _vocab(spark, sf_dir)
    encoded = tokens.encode(positions, ["row_position"], {"ids": "text"}, vocab)
    blocks = tokens.pack(stage(encoded, "encoded"), "row_position", "ids", MAX_TOKENS)
    return blocks.select(
        "block",
        F.size("input_ids").cast("bigint").alias("n"),
        joined(F.col("input_ids")).alias("ids"),
    )


@case(
    f"""with {TURNS}, {VOCAB}, rendered as (
      select conv_id, regexp_extract_all(string_agg(
        case when role in ('user', 'system', 'assistant')
             then '{START}' || role || chr(10) || content || '{EOS}' || chr(10) else '' end,
        '' order by turn), '{TOKEN}') as t
      from turns group by conv_id),
    long_chat as (
      select conv_id, unnest(t) as token, generate_subscripts(t, 1) as pos from rendered)
    select conv_id,
           array_to_string(list(coalesce(token_id, 1) order by pos)[1:{MAX_TOKENS}], '|') as input_ids
    from long_chat left join vocab using (token) group by conv_id"""
)
def encode_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations through the role template, encoded and truncated."""
    rendered = conversations.assemble(turns(spark, sf_dir), ["conv_id"]).select(
        "conv_id", chat.role_template(F.col("messages"), START, EOS).alias("text")
    )
    rendered = stage(rendered, "rendered")
    encoded = tokens.encode(rendered, ["conv_id"], {"ids": "text"}, _vocab(spark, sf_dir))
    cut = tokens.truncate(F.col("ids"), MAX_TOKENS)
    return encoded.select("conv_id", joined(cut).alias("input_ids"))


BEST_FIT = f"""items as materialized (
      select row_number() over (order by size desc, doc_id) as i, doc_id, size from sized),
    placed(i, doc_id, size, block, start, room) as (
      select 0::bigint, null::bigint, null::bigint, null::bigint, null::bigint, []::bigint[]
      union all
      select i, doc_id, size, best - 1, {MAX_TOKENS} - coalesce(room[best], {MAX_TOKENS}),
             list_transform(case when best > len(room) then room || [{MAX_TOKENS}::bigint] else room end,
                            lambda r, k: case when k = best then r - size else r end)
      from (
        select n.i, n.doc_id, n.size, p.room,
               coalesce(list_position(p.room, list_min(list_filter(p.room, lambda r: r >= n.size))),
                        len(p.room) + 1)::bigint as best
        from placed p join items n on n.i = p.i + 1))"""


@case(
    f"""with recursive sized as (
      select doc_id, least(len(regexp_extract_all(text, '{TOKEN}')), {MAX_TOKENS - 1}) + 1 as size from documents),
    {BEST_FIT}
    select doc_id, size, block, start from placed where i > 0"""
)
def pack_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block that holds each document whole, and where it begins there."""
    placed = with_row_position(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "row_position", "doc_id", token_count(F.col("text")).alias("n_tokens")
    )
    plan = packing.whole_plan(stage(placed, "token-counts"), "row_position", "n_tokens", MAX_TOKENS)
    return plan.select("doc_id", "size", "block", "start")


@case(
    f"""with recursive {VOCAB}, {ENCODED}, sized as (
      select doc_id, ids[1:{MAX_TOKENS - 1}] as ids, least(len(ids), {MAX_TOKENS - 1}) + 1 as size from all_ids),
    {BEST_FIT},
    flat as (
      select block, start, size, array_to_string(list_append(ids, 2), '|') as text
      from placed join sized using (doc_id, size))
    select block, sum(size)::bigint as n, string_agg(text, '|' order by start) as ids
    from flat group by block"""
)
def whole_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded, ended and packed without cutting any at a block's end."""
    positions = with_row_position(read(spark, sf_dir, "documents").select("doc_id", "text"))
    vocab = _vocab(spark, sf_dir)
    encoded = stage(tokens.encode(positions, ["row_position"], {"ids": "text"}, vocab), "encoded")
    blocks = packing.pack_whole(encoded, "row_position", "ids", MAX_TOKENS)
    return blocks.select(
        "block", F.size("input_ids").cast("bigint").alias("n"), joined(F.col("input_ids")).alias("ids")
    )
