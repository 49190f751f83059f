"""Sources, sinks, columns, profiles, sampling and weighted groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.chat import nth_content
from corpusmill.operators import columns, custom, distribution, mixture, profile, sampling
from corpusmill.operators.chunking import chunk_documents as chunks
from corpusmill.operators.chunking import chunk_greedily as greedy_chunks
from corpusmill.operators.ordering import hash_position
from corpusmill.operators.tokens import batches, pack_plan
from corpusmill.functions.constants import MAX_TOKENS
from corpusmill.functions.text import token_count
from corpusmill.plans.training_text import questions_to_chat
from corpusmill.schemas import PREFERENCES_RAW
from corpusmill.session import stage, staging_path
from corpusmill.sources import json_arrays, releases, sinks, tables
from corpusmill.streaming.sample import save_percent_sample
from workload.inputs import TOKEN, chosen_sql, draw_sql, joined, micros, read, read_wide
from workload.registry import case

SPLIT = f"case when {chosen_sql(0.05, 'doc_id')} then 'test' else 'train' end"


def _published(spark: SparkSession, sf_dir: str) -> str:
    """The documents, published with a config per language and a 5 % test split."""
    path = staging_path(spark, "published")
    documents = read(spark, sf_dir, "documents")
    labelled = documents.withColumnRenamed("lang", "config").withColumn(
        "split", sampling.split_label(["doc_id"])
    )
    sinks.write_splits(labelled, path)
    return path


@case(f"select doc_id, source, n_chars from documents where lang = 'en' and {SPLIT} = 'train'")
def scan_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _published(spark, sf_dir)
    return tables.scan_split(spark, root, "en", "train", ["doc_id", "source", "n_chars"])


@case(f"select distinct lang as config, {SPLIT} as split from documents")
def list_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.list_splits(spark.read.parquet(_published(spark, sf_dir)))


@case(
    f"""with d as (select lang as config, {SPLIT} as split, n_chars from documents)
    select config, split, count(*)::bigint as n, sum(n_chars)::bigint as n_chars
    from (select * from d union all select 'all', split, n_chars from d) group by all"""
)
def publish_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    everything = sinks.with_all_config(spark.read.parquet(_published(spark, sf_dir)))
    return everything.groupBy("config", "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars")
    )


@case(
    """select doc_id, n_chars from documents
    where doc_id < floor((select count(*) from documents) * 1 / 100)"""
)
def head_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.head_percent(read(spark, sf_dir, "documents"), 1).select("doc_id", "n_chars")


@case("select p_partkey, row_number() over (order by p_partkey) - 1 as row_position from part")
def row_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.with_row_position(read(spark, sf_dir, "part")).select(
        "p_partkey", "row_position"
    )


RAW = """raw as (
  select case event_id % 10 when 0 then 'x' when 1 then user_id || '.0'
              else user_id::varchar end as course_id,
         event_id::varchar as question_id, event_type as question_body,
         props as question_answer, 'open' as question_type
  from events)"""


def _preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question rows with dirty numbers."""
    user = F.col("user_id").cast("string")
    last = F.col("event_id") % 10
    course = F.when(last == 0, F.lit("x")).when(last == 1, F.concat(user, F.lit(".0")))
    return read(spark, sf_dir, "events").select(
        "event_id",
        course.otherwise(user).alias("course_id"),
        F.col("event_id").cast("string").alias("question_id"),
        F.col("event_type").alias("question_body"),
        F.col("props").alias("question_answer"),
        F.lit("open").alias("question_type"),
    )


def _json_arrays(df: DataFrame, position: str, rows_per_file: int, path: str) -> None:
    """Write rows as files of one JSON array each."""
    number = F.col(position)
    total = df.count()
    line = F.to_json(F.struct(*[c for c in df.columns if c != position]))
    opening = F.when(number % rows_per_file == 0, F.lit("[")).otherwise(F.lit(","))
    ends = (number % rows_per_file == rows_per_file - 1) | (number == total - 1)
    closing = F.when(ends, F.lit("]")).otherwise(F.lit(""))
    shard = F.floor(number / rows_per_file)
    (
        df.select(
            shard.alias("shard"), number.alias("n"), F.concat(opening, line, closing).alias("value")
        )
        .repartition("shard")
        .sortWithinPartitions("shard", "n")
        .select("value", "shard")
        .write.partitionBy("shard")
        .text(path)
    )


@case(
    f"""with {RAW}, clean as (
      select try_cast(try_cast(course_id as double) as integer) as course_id,
             try_cast(try_cast(question_id as double) as integer) as question_id,
             question_body, question_answer
      from raw)
    select 'local_' || coalesce(course_id::varchar, 'null') || '_' || question_id as id,
           'local' as source, question_body as user_text, question_answer as assistant_text
    from clean"""
)
def json_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "preferences")
    _json_arrays(_preferences(spark, sf_dir), "event_id", 50_000, path)
    raw = tables.scan_json_array(spark, path, PREFERENCES_RAW)
    return questions_to_chat(raw, "local").select(
        "id",
        "source",
        nth_content(F.col("messages"), 0).alias("user_text"),
        nth_content(F.col("messages"), 1).alias("assistant_text"),
    )


@case(
    f"""with {RAW}
    select try_cast(try_cast(course_id as double) as integer) as course_id,
           try_cast(try_cast(question_id as double) as integer) as question_id,
           question_body, question_answer, question_type
    from raw"""
)
def coerce_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.clean_preferences(_preferences(spark, sf_dir))


@case("select doc_id as id, text as content, lang as language from documents")
def rename_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    renamed = columns.rename(documents, {"doc_id": "id", "text": "content", "lang": "language"})
    return columns.keep(renamed, ["id", "content", "language"])


DESCRIBED = {
    "documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"},
    "labels": {"quality": "int", "toxic": "int"},
}


@case(
    " union all ".join(
        f"select '{name}' as column_name, '{kind}' as column_type, "
        f"count(*) filter ({name} is null) as null_count from documents left join labels using (doc_id)"
        for columns_ in DESCRIBED.values()
        for name, kind in columns_.items()
    )
)
def describe_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of the documents and of their labels."""
    labels = read(spark, sf_dir, "labels")
    return profile.describe_columns(read(spark, sf_dir, "documents").join(labels, "doc_id", "left"))


@case("select doc_id, source from documents anti join (select doc_id from labels where toxic = 1) using (doc_id)")
def deny_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = read(spark, sf_dir, "labels").where("toxic = 1")
    documents = read(spark, sf_dir, "documents").select("doc_id", "source")
    return mixture.exclude_listed(documents, toxic, "doc_id")


@case("select doc_id, source from documents semi join (select doc_id from labels where quality = 1) using (doc_id)")
def allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = read(spark, sf_dir, "labels").where("quality = 1")
    documents = read(spark, sf_dir, "documents").select("doc_id", "source")
    return mixture.allow_listed(documents, good, "doc_id")


@case(
    """select doc_id as id, text, source, n_chars from documents
    union all select item_id, text, 'benchmark', null from benchmark
    union all select conv_id, text, 'conversations', null from conversations"""
)
def concat_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "text", "source", "n_chars"
    )
    benchmark = read(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("id"), "text", F.lit("benchmark").alias("source")
    )
    conversations = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("id"), "text", F.lit("conversations").alias("source")
    )
    return mixture.concat([documents, benchmark, conversations])


WEIGHTS = {"src0": 0.25, "src1": 1.0, "src2": 2.5, "src3": 1.5, "src4": 0.0}
WEIGHT_ROWS = ", ".join(f"('{s}', {int(w)}, {w - int(w)})" for s, w in WEIGHTS.items())


@case(
    f"""with w(source, whole, part) as (values {WEIGHT_ROWS}), c as (
      select doc_id, source,
             whole + case when {draw_sql('doc_id')} < part * 4294967296
                     then 1 else 0 end as copies
      from documents join w using (source))
    select doc_id, source, copy::integer as copy
    from c, lateral (select unnest(range(1, copies + 1)) as copy)"""
)
def weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "source")
    return mixture.weighted_mix(documents, WEIGHTS, ["doc_id"], 42)


@case(
    """select doc_id, length(text) as n,
           (length(text) - length(replace(text, chr(10), '')) + 1)::bigint as lines
    from documents"""
)
def map_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's code over batches; defined in here so that it travels to the workers by value."""

    def measure(batch):
        n, lines = batch["text"].str.len(), batch["text"].str.count("\n") + 1
        return batch.assign(n=n, lines=lines)[["n", "lines"]]

    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return custom.map_batches(documents, ["text"], measure, "n bigint, lines bigint", ["text"])


@case("select distinct source from documents")
def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.distinct_values(read(spark, sf_dir, "documents"), "source")


@case("select round(sum(strlen(text)) / 1048576 * 1000000)::bigint as size_micro_mb from documents")
def size_mb(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = profile.size_mb(read(spark, sf_dir, "documents"), "text")
    return size.select(micros(F.col("size_mb")).alias("size_micro_mb"))


@case(
    """select doc_id, row_number() over (order by md5('42:' || doc_id), doc_id) - 1 as position
    from documents"""
)
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id")
    return hash_position(documents, 42, ["doc_id"], "position")


@case(
    """select doc_id, row_number() over (order by md5('42:' || doc_id), doc_id) - 1 as position
    from documents"""
)
def shuffled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shuffled table itself, with the place that each row has in it."""
    documents = read(spark, sf_dir, "documents").select("doc_id")
    shuffled = stage(sampling.shuffle(documents, ["doc_id"]), "shuffled")
    return tables.with_row_position(shuffled, "position")


@case(
    """select doc_id, text, row_number() over (order by md5('42:' || doc_id), doc_id) - 1 as position
    from documents order by position limit 200"""
)
def sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return sampling.sample_n(documents, 200, ["doc_id"])


@case(f"select doc_id, {SPLIT} as split from documents")
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return documents.select("doc_id", sampling.split_label(["doc_id"]).alias("split"))


@case(
    """with p as (
      select doc_id, row_number() over (order by md5('42:' || doc_id), doc_id) - 1 as position,
             count(*) over () as n
      from documents)
    select doc_id, case when position < ceil(n * 0.05::double) then 'test' else 'train' end as split
    from p"""
)
def exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.exact_split(read(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])


@case(f"select doc_id, text from documents where {chosen_sql(0.01, 'doc_id')}")
def percent_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return sampling.percent_sample(documents, 1, ["doc_id"])


@case(f"select doc_id, text from documents where {chosen_sql(0.01, 'doc_id')}")
def stream_percent_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch sample again, through a file stream and a table."""
    schema = read(spark, sf_dir, "documents").schema
    # A pattern, since a stream cannot start from the bare path of one file.
    stream = tables.scan_stream(spark, f"{sf_dir}/documents.parquet*", schema)
    texts = stream.select("doc_id", "text")
    out, checkpoint = staging_path(spark, "sampled"), staging_path(spark, "progress")
    save_percent_sample(texts, 1, ["doc_id"], out, checkpoint)
    return tables.scan_saved(spark, out, texts.schema)


@case(
    """with w as (
      select doc_id, source, n_chars,
             sum(n_chars) over (partition by source order by n_chars desc, doc_id
                                rows between unbounded preceding and 1 preceding) as before,
             sum(n_chars) over (partition by source) as total
      from documents)
    select doc_id, source, n_chars from w
    where coalesce(before, 0)::double <= 0.7::double * total::double"""
)
def top_p_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return distribution.top_p(documents, "source", "n_chars", ["doc_id"], 0.7)


@case(
    """with e as (
      select doc_id, source,
             exp((n_chars - max(n_chars) over (partition by source)) / 1000::double / 2) as e
      from documents)
    select doc_id, source, round(e / sum(e) over (partition by source) * 1000000)::bigint as p_micro
    from e"""
)
def group_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.col("n_chars") / 1000).alias("score")
    )
    shares = distribution.softmax(documents, "source", "score", temperature=2.0)
    return shares.select("doc_id", "source", micros(F.col("probability")).alias("p_micro"))


@case(
    f"""with t as (
      select doc_id, source, n_chars,
             -ln(({draw_sql('doc_id')}::double + 0.5) / 4294967296) / n_chars as ticket
      from documents where n_chars > 0)
    select source, arg_min(doc_id, ticket) as doc_id from t group by source"""
)
def weighted_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    drawn = distribution.weighted_draw(documents, "source", F.col("n_chars"), ["doc_id"])
    return drawn.select("source", "doc_id")


@case(
    """select (doc_id // 8)::bigint as batch, string_agg(doc_id::varchar, '|' order by doc_id) as doc_ids,
           string_agg(lang, '|' order by doc_id) as langs
    from documents group by 1"""
)
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = tables.with_row_position(read(spark, sf_dir, "documents"))
    grouped = batches(placed, "row_position", ["doc_id", "lang"], 8)
    return grouped.select(
        "batch",
        joined(F.col("doc_id")).alias("doc_ids"),
        joined(F.col("lang")).alias("langs"),
    )


@case(
    f"""with t as (
      select doc_id, len(regexp_extract_all(text, '{TOKEN}')) as n_tokens from documents),
    s as (
      select *, coalesce(sum(n_tokens + 1) over (order by doc_id
                rows between unbounded preceding and 1 preceding), 0)::bigint as start
      from t)
    select doc_id, n_tokens::bigint as n_tokens, start, (start // {MAX_TOKENS})::bigint as first_block,
           ((start + n_tokens) // {MAX_TOKENS})::bigint as last_block,
           (start + n_tokens) // {MAX_TOKENS} > start // {MAX_TOKENS} as crosses
    from s"""
)
def pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = tables.with_row_position(read(spark, sf_dir, "documents"))
    placed = texts.repartition(spark.sparkContext.defaultParallelism).select(
        "row_position", "doc_id", token_count(F.col("text")).alias("n_tokens")
    )
    # The plan reads its input twice; staged, the texts are read and cut into tokens once.
    counted = stage(placed, "token-counts")
    return pack_plan(counted, "row_position", "n_tokens", MAX_TOKENS).drop("row_position")


MARKDOWN = [r"\n#{1,6} ", r"```\n", r"\n\*\*\*+\n", r"\n---+\n", r"\n___+\n", r"\n\n", r"\n", " "]


def _cut_sql(size: int) -> str:
    """Pieces by position: the lengths of what lies between matches, and of the matches, add up to
    where each piece starts."""
    steps = []
    for i, separator in enumerate(MARKDOWN, start=1):
        steps.append(
            f"""c{i} as (
      select doc_id, place, piece, case when length(piece) > {size}
             then [0] || list_transform(range(1, len(string_split_regex(piece, '{separator}'))), lambda k:
                    (list_sum(list_transform(string_split_regex(piece, '{separator}')[1:k], lambda x: length(x)))
                     + coalesce(list_sum(list_transform(regexp_extract_all(piece, '{separator}')[1:k - 1],
                                lambda x: length(x))), 0))::bigint)
             else [0] end as starts
      from s{i - 1}),
    u{i} as (
      select doc_id, place, piece, unnest(starts) as start,
             unnest(starts[2:] || [length(piece)]) as stop,
             generate_subscripts(starts, 1) as part from c{i}),
    s{i} as (
      select doc_id, place || [part] as place, substr(piece, start + 1, stop - start) as piece
      from u{i} where stop > start)"""
        )
    last = len(MARKDOWN)
    return ",\n".join(
        [
            *steps,
            f"""pieces as (
      select doc_id, place || [k] as place, substr(piece, (k * {size} + 1)::bigint, {size}) as piece
      from s{last}, lateral (select unnest(range((length(piece) + {size - 1}) // {size})) as k)),
    placed as (
      select doc_id, place, piece,
             coalesce(sum(length(piece)) over (partition by doc_id order by place
                      rows between unbounded preceding and 1 preceding), 0) as start
      from pieces)""",
        ]
    )


def _stretches_sql(size: int) -> str:
    return f"""{_cut_sql(size)}
    select doc_id, (start // {size} + (start + length(piece) - 1) // {size})::bigint as chunk,
           string_agg(piece, '' order by place) as text
    from placed group by 1, 2"""


def _greedy_sql(size: int) -> str:
    """One chunk of every document after the other, each up to the piece that doesn't fit."""
    return f"""{_cut_sql(size)},
    numbered as materialized (
      select doc_id, row_number() over (partition by doc_id order by place) as i, piece, start,
             start + length(piece) as stop from placed),
    merged as (
      select doc_id, 0 as chunk, 0::hugeint as start from numbered where i = 1
      union all
      select m.doc_id, m.chunk + 1, min(n.start)
      from merged m join numbered n on n.doc_id = m.doc_id and n.stop - m.start > {size}
      group by m.doc_id, m.chunk)
    select n.doc_id, m.chunk::int as chunk, string_agg(n.piece, '' order by n.i) as text
    from numbered n asof join merged m on n.doc_id = m.doc_id and n.start >= m.start
    group by n.doc_id, m.chunk"""


@case(
    f"""with s0 as (select doc_id, [0] as place, text as piece from documents where text <> ''),
    {_stretches_sql(1000)}"""
)
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(read_wide(spark, sf_dir, "documents"), ["doc_id"], "text", 1000)


@case(
    f"""with s0 as (
      select doc_id, [0] as place, replace(text, ' the ', chr(64976) || chr(10) || '## ' || chr(64976)) as piece
      from documents where text <> ''),
    {_stretches_sql(200)}"""
)
def chunk_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with headings and with characters that are reserved for a program's own use."""
    mark = chr(64976)
    text = F.replace(F.col("text"), F.lit(" the "), F.lit(f"{mark}\n## {mark}"))
    documents = read_wide(spark, sf_dir, "documents").withColumn("text", text)
    return chunks(documents, ["doc_id"], "text", 200)


@case(
    f"""with recursive s0 as (select doc_id, [0] as place, text as piece from documents where text <> ''),
    {_greedy_sql(1000)}"""
)
def chunk_greedily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy_chunks(read_wide(spark, sf_dir, "documents"), ["doc_id"], "text", 1000)


PROBABILITIES = {"src0": 0.1, "src1": 0.2, "src2": 0.3, "src3": 0.4}
_EDGES = [(s, int(sum(list(PROBABILITIES.values())[: i + 1]) * (1 << 32))) for i, s in enumerate(PROBABILITIES)]
_PICK = " ".join(f"when drawn < {edge} then '{s}'" for s, edge in _EDGES[:-1])


def _interleaved_sql(ends: str) -> str:
    """The draws of more places than the order can have, and what each takes of its source."""
    return f"""with sized as (
      select source, count(*) as size from documents where source in {tuple(PROBABILITIES)} group by source),
    draws as (
      select place, case {_PICK} else '{_EDGES[-1][0]}' end as source
      from (select place, {draw_sql('place')} as drawn
            from range((select count(*) * 20 from documents)) r(place))),
    taken as (
      select place, source, size, row_number() over (partition by source order by place) - 1 as n
      from draws join sized using (source)),
    last as (select {ends}(place) as place from taken where n = size - 1),
    rows as (
      select doc_id, source, row_number() over (partition by source order by doc_id) - 1 as n from documents)
    select r.doc_id, t.source, t.place as "order"
    from taken t join rows r on r.source = t.source and r.n = t.n % t.size
    where t.place <= (select place from last)"""


def _interleaved(spark: SparkSession, sf_dir: str, stop: str) -> DataFrame:
    placed = tables.with_row_position(read(spark, sf_dir, "documents").select("doc_id", "source"))
    mixed = mixture.interleave(stage(placed, "placed"), "row_position", PROBABILITIES, 42, stop=stop)
    return mixed.drop("row_position")


@case(_interleaved_sql("min"))
def interleave_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In drawn order until a source is exhausted."""
    return _interleaved(spark, sf_dir, "first")


@case(_interleaved_sql("max"))
def interleave_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In drawn order until every source has been exhausted."""
    return _interleaved(spark, sf_dir, "all")


def _epoch_sql(epoch: int) -> str:
    keys = [sampling._round_key(42, epoch, r) for r in range(1, sampling.ROUNDS + 1)]
    other = f"((({keys}[r] - x) % n + n) % n)"
    bit = f"ascii(md5('42:{epoch}:' || r || ':' || greatest(x, {other}))) % 2"
    return f"""select doc_id, {epoch}::int as epoch, list_reduce(
        range(1, {sampling.ROUNDS + 1}), lambda x, r: case when {bit} = 1 then {other} else x end, doc_id)::bigint as place
      from documents, (select count(*) as n from documents)"""


@case(" union all ".join(_epoch_sql(e) for e in range(2)))
def epoch_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two epochs' orders of the documents, whose ids are their positions."""
    documents = read(spark, sf_dir, "documents").select("doc_id")
    placed = tables.with_row_position(documents, "row_position")
    return sampling.epochs(placed, "row_position", documents.count(), 2).drop("row_position")


@case("select event_id, user_id, event_type, props from events")
def json_array_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one JSON array in one file, written and then read by many tasks."""
    path = staging_path(spark, "json-array")
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    lines = F.concat(F.when(F.monotonically_increasing_id() == 0, F.lit("[")).otherwise(F.lit(",")), F.to_json(F.struct("*")))
    one = events.coalesce(1).select(lines.alias("value"))
    closing = spark.range(1).select(F.lit("]").alias("value"))
    one.unionByName(closing).coalesce(1).write.text(path)
    return json_arrays.scan_json_array_in_parts(spark, path, events.schema)


@case(
    f"""select doc_id, lang as config, {SPLIT} as split from documents
    where lang is not null and lang <> 'fr' and (lang <> 'en' or doc_id % 2 = 0)"""
)
def republished_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A config per language; then one of them anew with half its rows, and one left out."""
    path = staging_path(spark, "releases")
    documents = read(spark, sf_dir, "documents").where("lang is not null").select(
        "doc_id", F.col("lang").alias("config"), sampling.split_label(["doc_id"]).alias("split")
    )
    releases.publish(documents, path)
    releases.publish(documents.where("config = 'en' and doc_id % 2 = 0"), path, drop=("fr",))
    held = [c for c in releases.release(spark, path)[1]]
    frames = [releases.scan_release(spark, path, c, split=None) for c in held]
    return mixture.concat(frames).select("doc_id", "config", "split")
