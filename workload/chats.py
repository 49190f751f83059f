"""Conversations: rendering, filters, profiles, language and the mixture job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import chat, text
from corpusmill.functions.hashing import chosen
from corpusmill.operators import conversations, langid, mixture, profile
from corpusmill.plans.chat_mixture import build_mixture, funnel_stages
from corpusmill.plans.training_text import build_training_text
from corpusmill.functions.constants import SEED
from corpusmill.operators.sampling import sample_n
from corpusmill.operators.skew import null_safe
from corpusmill.session import stage
from workload.inputs import (
    EOS,
    EXCLUDED,
    LENGTHS,
    SOURCE_MAP,
    START,
    TURNS,
    chosen_sql,
    draw_sql,
    read,
    read_wide,
    turns,
)
from workload.registry import case

MAP_ROWS = ", ".join(f"('{s}', '{c}')" for s, c in SOURCE_MAP.items())
TRIM = r"'^\s+|\s+$', '', 'g'"
PIECE = f"""case when lower(coalesce(role, '')) in ('user', 'assistant')
    then coalesce(content, '') || chr(10) || chr(10) else '' end || '{EOS}'"""
SFT = f"regexp_replace(string_agg({PIECE}, '' order by turn), {TRIM})"


def _assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.assemble(turns(spark, sf_dir), ["conv_id", "source"])


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.lengths(turns(spark, sf_dir), ["conv_id", "source"])


@case(f"with {TURNS} select conv_id, {SFT} as text from turns group by conv_id")
def render_sft_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.sft_text(turns(spark, sf_dir), ["conv_id"], EOS)


FIRST = """coalesce(arg_min(content, turn) filter (role = '{}'), '')"""


@case(
    f"""with {TURNS}
    select conv_id, '### Instruction:' || chr(10) || {FIRST.format('user')} || chr(10) || chr(10)
           || '### Response:' || chr(10) || {FIRST.format('assistant')} as text
    from turns group by conv_id"""
)
def render_instruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    firsts = conversations.first_contents(
        turns(spark, sf_dir), ["conv_id"], {"asked": "user", "said": "assistant"}
    )
    return firsts.select("conv_id", chat.instruction(F.col("asked"), F.col("said")).alias("text"))


@case(
    f"""with {TURNS}
    select conv_id, string_agg(case when role in ('user', 'system', 'assistant')
             then '{START}' || role || chr(10) || content || '{EOS}' || chr(10) else '' end,
             '' order by turn) || 'assistant' || chr(10) as text
    from turns group by conv_id"""
)
def render_role_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = chat.role_template(F.col("messages"), START, EOS, add_generation_prompt=True)
    return _assembled(spark, sf_dir).select("conv_id", rendered.alias("text"))


@case(f"with {TURNS} select conv_id, arg_min(content, turn) as content from turns group by conv_id")
def first_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.first_contents(turns(spark, sf_dir), ["conv_id"], {"content": None})


@case(
    f"""with {TURNS}
    select conv_id, case when arg_min(role, turn) = 'system' then '' else 'system|' end
           || string_agg(role, '|' order by turn) as roles,
           (count(*) + case when arg_min(role, turn) = 'system' then 0 else 1 end)::bigint as n
    from turns group by conv_id"""
)
def insert_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    complete = _assembled(spark, sf_dir).withColumn(
        "messages", chat.with_system(F.col("messages"))
    )
    return complete.select(
        "conv_id",
        F.array_join("messages.role", "|").alias("roles"),
        F.size("messages").cast("bigint").alias("n"),
    )


@case(
    """select 'doc_' || doc_id as id, 'documents' as source, text as user_text,
           lang as assistant_text, 'user|assistant' as roles
    from documents"""
)
def qa_to_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = read(spark, sf_dir, "documents").select(
        F.format_string("doc_%d", "doc_id").alias("id"),
        F.lit("documents").alias("source"),
        chat.question_answer(F.col("text"), F.col("lang")).alias("messages"),
    )
    return chats.select(
        "id",
        "source",
        chat.nth_content(F.col("messages"), 0).alias("user_text"),
        chat.nth_content(F.col("messages"), 1).alias("assistant_text"),
        F.array_join("messages.role", "|").alias("roles"),
    )


@case(
    """with marked as (
      select conv_id, turn, case when conv_id % 3 = 0 then text
             else text || '</think>' || text || '</think>' || conv_id end as t
      from conversations),
    cut as (
      select *, string_split(t, '</think>') as parts from marked)
    select conv_id, turn,
           regexp_replace(array_to_string(parts[:-2], '</think>'), '^\\n+|\\n+$', '', 'g') as thinking,
           regexp_replace(parts[-1], '^\\n+|\\n+$', '', 'g') as content
    from cut"""
)
def split_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    close = F.lit("</think>")
    spoken = F.concat("text", close, "text", close, F.col("conv_id").cast("string"))
    marked = F.when(F.col("conv_id") % 3 == 0, F.col("text")).otherwise(spoken)
    return (
        read(spark, sf_dir, "conversations")
        .withColumn("_t", marked)
        .select(
            "conv_id",
            "turn",
            text.reasoning_thinking(F.col("_t")).alias("thinking"),
            text.reasoning_content(F.col("_t")).alias("content"),
        )
    )


@case(
    f"""with {TURNS} select conv_id, turn, source, content from turns
    where source is null or source not in ('src3')"""
)
def exclude_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = mixture.exclude_sources(turns(spark, sf_dir), EXCLUDED)
    return kept.select("conv_id", "turn", "source", "content")


@case(
    f"""with {TURNS}
    select conv_id, source, arg_min(content, turn) as first_text, arg_max(content, turn) as last_text
    from turns group by conv_id, source having count(*) = 2"""
)
def two_turn_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = conversations.two_message(turns(spark, sf_dir), ["conv_id", "source"])
    return pairs.select(
        "conv_id",
        "source",
        chat.nth_content(F.col("messages"), 0).alias("first_text"),
        chat.nth_content(F.col("messages"), 1).alias("last_text"),
    )


@case(
    f"""with {LENGTHS}, m(source, config) as (values {MAP_ROWS})
    select conv_id, source, config, n_messages from lengths join m using (source)"""
)
def map_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.map_sources(_lengths(spark, sf_dir), SOURCE_MAP)


@case(
    f"""with {LENGTHS} select count(*) filter (n_messages = 2) as n_ordinary,
    count(*) filter (n_messages <> 2) as n_other from lengths"""
)
def length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.length_profile(_lengths(spark, sf_dir))


@case(
    f"""with {LENGTHS} select n_messages, count(*) as n from lengths
    where n_messages <> 2 group by n_messages"""
)
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.length_histogram(_lengths(spark, sf_dir))


@case(f"with {LENGTHS} select distinct source from lengths where n_messages <> 2")
def bad_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.bad_sources(_lengths(spark, sf_dir))


def _local(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat(F.lit("item "), F.col("item_id").cast("string"))
    return read(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("local_"), F.col("item_id").cast("string")).alias("id"),
        chat.question_answer(F.col("text"), answer).alias("messages"),
        F.lit("local").alias("source"),
    )


LOCAL = """select 'local_' || item_id as id, 'local' as source, 'local' as config,
       text as user_text, 'item ' || item_id as assistant_text from benchmark"""


def _mixture(spark: SparkSession, sf_dir: str, english=None) -> DataFrame:
    pairs = conversations.two_message(turns(spark, sf_dir), ["conv_id", "source"])
    chats = pairs.select(F.col("conv_id").cast("string").alias("id"), "messages", "source")
    built = build_mixture(
        chats, SOURCE_MAP, EXCLUDED, _local(spark, sf_dir), "local", english
    )
    return built.select(
        "id",
        "source",
        "config",
        chat.nth_content(F.col("messages"), 0).alias("user_text"),
        chat.nth_content(F.col("messages"), 1).alias("assistant_text"),
    )


MAPPED = f"""m(source, config) as (values {MAP_ROWS}), pairs as (
  select conv_id, source, arg_min(content, turn) as user_text, arg_max(content, turn) as assistant_text
  from turns where source is null or source not in ('src3')
  group by conv_id, source having count(*) = 2)"""


@case(
    f"""with {TURNS}, {MAPPED}
    select conv_id::varchar as id, source, config, user_text, assistant_text
    from pairs join m using (source) union all {LOCAL}"""
)
def mixture_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)


def profile_sql(where: str = "true") -> str:
    """Trigram log-probabilities per language, with the floor of unseen trigrams."""
    return f"""plain as (
      select doc_id, lang, lower(regexp_replace(text, '\\P{{L}}+', ' ', 'g')) as s
      from documents where {where}),
    grams as (
      select lang, unnest(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) as gram
      from plain),
    seen as (select lang, gram, count(*) as n from grams group by all),
    vocab as (select count(distinct gram) as v from seen),
    langs as (select lang, sum(n) as total from seen group by lang),
    weights as (
      select lang, gram, n, round(ln((n + 1)::double / (total + v)::double) * 1000000)::bigint as logp
      from seen join langs using (lang), vocab),
    floors as (
      select lang, round(ln(1::double / (total + v)::double) * 1000000)::bigint as low
      from langs, vocab)"""


def detect_sql(rows: str) -> str:
    """Language per (a, b) key of ``rows(a, b, t)``."""
    return f"""texts as ({rows}),
    parts as (
      select a, b, unnest(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) as gram
      from (select a, b, lower(regexp_replace(t, '\\P{{L}}+', ' ', 'g')) as s from texts)),
    counted as (select a, b, gram, count(*) as c from parts group by all),
    sizes as (select a, b, sum(c) as n_grams from counted group by all),
    gains as (
      select a, b, w.lang, sum(c * (logp - low)) as gain
      from counted join weights w using (gram) join floors f on f.lang = w.lang group by all),
    scores as (
      select a, b, f.lang, coalesce(gain, 0) + n_grams * low as score
      from sizes cross join floors f left join gains using (a, b, lang)),
    ranked as (
      select *, row_number() over (partition by a, b order by score desc, lang) as place from scores),
    detected as (
      select a, b, coalesce(n_grams, 0)::bigint as n_grams, score::bigint as score, lang
      from (select a, b from texts) left join sizes using (a, b)
      left join (from ranked where place = 1) using (a, b))"""


@case(f"with {profile_sql()} select lang, gram, n, logp from weights")
def lang_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.train(read_wide(spark, sf_dir, "documents")).profile()


MESSAGES = "select conv_id as a, turn as b, text as t from conversations"


@case(
    f"""with {profile_sql()}, {detect_sql(MESSAGES)}
    select a as conv_id, b as turn, n_grams, score, lang from detected"""
)
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.train(read_wide(spark, sf_dir, "documents"))
    return langid.detect(turns(spark, sf_dir), ["conv_id", "turn"], "content", model)


@case(
    f"""with {LENGTHS}, m(source, config) as (values {MAP_ROWS}), {profile_sql()}, {detect_sql(MESSAGES)},
    english as (
      select a as conv_id, bool_and(coalesce(lang = 'en', false)) as english from detected group by a),
    reached as (
      select (l.source is null or l.source <> 'src3') as b, n_messages = 2 as c, english as d,
             m.source is not null as e
      from lengths l join english using (conv_id) left join m on l.source = m.source),
    f as (
      select count(*) as n0, count(*) filter (b) as n1, count(*) filter (b and c) as n2,
             count(*) filter (b and c and d) as n3, count(*) filter (b and c and d and e) as n4
      from reached)
    select 0 as step, 'all' as stage, n0 as n from f union all select 1, 'not_excluded', n1 from f
    union all select 2, 'two_messages', n2 from f union all select 3, 'english', n3 from f
    union all select 4, 'mapped', n4 from f"""
)
def filter_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step from all conversations to the mapped ones; the language is judged only of those
    that the steps before it leave."""
    model = langid.train(read_wide(spark, sf_dir, "documents"))
    messages = turns(spark, sf_dir)
    chats = conversations.lengths(messages, ["conv_id", "source"])
    before = [reached for _, reached in funnel_stages(EXCLUDED, SOURCE_MAP)[:2]]
    left = chats.where(before[0] & before[1]).select("conv_id")
    judged = null_safe(messages, left, ["conv_id"], "left_semi")
    foreign = langid.foreign_conversations(judged, ["conv_id"], "turn", "content", model, "en")
    chats = null_safe(chats, foreign.withColumn("foreign", F.lit(True)), ["conv_id"], "left")
    chats = chats.withColumn("english", F.col("foreign").isNull())
    return profile.funnel(chats, funnel_stages(EXCLUDED, SOURCE_MAP, F.col("english")))


@case(
    f"""with {profile_sql()}, {detect_sql(MESSAGES)},
    english as (
      select a as conv_id, bool_and(coalesce(lang = 'en', false)) as english from detected group by a),
    chats as (
      select conv_id, string_agg(text, '|' order by turn) as said from conversations group by conv_id)
    select case when conv_id % 5 = 0 then null else conv_id % 7 end as id, said
    from chats join english using (conv_id) where english"""
)
def english_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language is judged row by row: most ids repeat here, and some are null."""
    model = langid.train(read_wide(spark, sf_dir, "documents"))
    number = F.col("conv_id")
    rows = conversations.assemble(turns(spark, sf_dir), ["conv_id"]).select(
        F.when(number % 5 != 0, number % 7).alias("id"), "messages"
    )
    kept = langid.only_language(stage(rows, "chats"), model)
    return kept.select("id", F.array_join("messages.content", "|").alias("said"))


HELD_OUT = chosen_sql(0.2, "doc_id")


@case(
    f"""with {profile_sql('not ' + HELD_OUT)},
    {detect_sql('select doc_id as a, lang as b, text as t from documents where ' + HELD_OUT)}
    select b as lang, count(*) as n, count(*) filter (lang = b) as n_correct
    from detected group by b"""
)
def language_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the profiles of four fifths of the documents recognise the rest."""
    documents = read_wide(spark, sf_dir, "documents")
    held_out = chosen(0.2, 42, F.col("doc_id"))
    model = langid.train(documents.where(~held_out))
    rest = documents.where(held_out).withColumnRenamed("lang", "truth")
    labels = langid.detect(rest, ["doc_id", "truth"], "text", model)
    return labels.groupBy(F.col("truth").alias("lang")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("lang") == F.col("truth")).alias("n_correct"),
    )


@case(
    f"""with {profile_sql()}, {detect_sql(MESSAGES)}
    select a as conv_id, count(*) as n_messages from detected
    group by a having bool_and(coalesce(lang = 'en', false))"""
)
def english_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.train(read_wide(spark, sf_dir, "documents"))
    messages = turns(spark, sf_dir)
    foreign = langid.foreign_conversations(messages, ["conv_id"], "turn", "content", model, "en")
    kept = conversations.lengths(messages, ["conv_id"])
    return null_safe(kept, foreign, ["conv_id"], "left_anti")


@case(
    f"""with {TURNS}, {MAPPED}, {profile_sql()}, {detect_sql(MESSAGES)},
    english as (
      select a as conv_id from detected group by a having bool_and(coalesce(lang = 'en', false)))
    select conv_id::varchar as id, source, config, user_text, assistant_text
    from pairs join m using (source) semi join english using (conv_id) union all {LOCAL}"""
)
def mixture_build_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir, langid.train(read_wide(spark, sf_dir, "documents")))


@case(
    f"""with {TURNS}, taken as (
      select conv_id from (select distinct conv_id from turns)
      order by md5('42:' || conv_id), conv_id limit 50)
    select conv_id, text,
           case when {draw_sql('conv_id', 'split-42')} < 214748364 then 'test' else 'train' end as split
    from (select conv_id, {SFT} as text from turns semi join taken using (conv_id) group by conv_id)"""
)
def sft_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffle, take 50, render, split: the fine-tuning input.

    The conversations are chosen by their keys, and only the chosen ones are put together.
    """
    messages = turns(spark, sf_dir)
    taken = sample_n(conversations.lengths(messages, ["conv_id"]), 50, ["conv_id"], SEED, "_place")
    chosen_turns = null_safe(messages, taken.select("conv_id"), ["conv_id"], "left_semi")
    chats = conversations.assemble(chosen_turns, ["conv_id"])
    return build_training_text(chats, ["conv_id"], EOS)
