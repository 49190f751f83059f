"""Multiple-choice questions: adapters, prompts, choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import mcqa
from corpusmill.functions.constants import MCQA_HEADER
from corpusmill.operators import adapters, mixture
from corpusmill.operators.scoring import option_candidates as candidates
from corpusmill.plans.questions import prompt_batches, prompts
from workload import inputs
from workload.inputs import ARC_KEY, MATH_CHOICES, PARTS, joined, origin, shares
from workload.registry import case

ALLOWED = "lower(p_type) in ('economy', 'small')"
LETTER = "case when {0} between 0 and 3 then letters[{0} + 1] end"
PLAIN = "array_to_string(choices, '|')"
SHUFFLED = """list_transform(list_sort(list_transform(range(0, 4),
    lambda i: {'h': md5('42:' || pos || ':' || i), 'i': i, 'c': choices[i + 1]})), lambda x: x.c)"""


def _shown(questions: DataFrame) -> DataFrame:
    shown = questions.withColumn("choices", joined(F.col("choices")))
    return shown.drop("config", "split")


def _sql(
    name: str,
    subset: str,
    answer: str,
    where: str = "true",
    question: str = "p_name",
    choices: str = PLAIN,
    context: str = "null::varchar",
    number: str = "pos",
) -> str:
    return f"""select '{name}' as dataset, '{subset}_' || {number} as id, {question} as question,
    {choices} as choices, {answer} as answer, {context} as context from parts where {where}"""


# Per adapter: dataset, subset, split, table, and the rows as SQL.
SOURCES = {
    "mcqa_mmlu_aux": (
        "kz919/mmlu-auxiliary-train-auto-labelled",
        "aux",
        "train",
        lambda spark, sf_dir: inputs.subject_table(spark, sf_dir, "task"),
        dict(answer=LETTER.format("(p_partkey % 5)"), where=ALLOWED),
    ),
    "mcqa_mmlu": (
        "cais/mmlu",
        "mmlu",
        "validation",
        lambda spark, sf_dir: inputs.subject_table(spark, sf_dir, "subject"),
        dict(answer=LETTER.format("(p_partkey % 5)"), where=ALLOWED),
    ),
    "mcqa_arc": (
        "allenai/ai2_arc",
        "arc",
        "train",
        inputs.arc_table,
        dict(answer=ARC_KEY, number="p_partkey"),
    ),
    "mcqa_scienceqa": (
        "derek-thomas/ScienceQA",
        "science",
        "train",
        inputs.science_table,
        dict(
            answer=LETTER.format("(p_partkey % 5)"),
            where="p_partkey % 3 <> 0 and p_size % 2 = 0 and p_partkey % 5 <> 0",
        ),
    ),
    "mcqa_mathqa": (
        "allenai/math_qa",
        "math",
        "train",
        inputs.math_table,
        dict(
            answer="letters[(p_partkey % 5) + 1]",
            choices=f"array_to_string({MATH_CHOICES}, '|')",
            context="p_brand",
        ),
    ),
    "mcqa_openbook": (
        "allenai/openbookqa",
        "book",
        "test",
        inputs.openbook_table,
        dict(answer="letters[(p_partkey % 4) + 1]", context="p_brand"),
    ),
    "mcqa_sciq": (
        "allenai/sciq",
        "sciq",
        "train",
        inputs.sciq_table,
        dict(
            question="'which ' || p_name",
            choices=f"array_to_string({SHUFFLED}, '|')",
            answer=f"letters[list_position({SHUFFLED}, 'size ' || p_size)]",
            context="p_brand",
        ),
    ),
    "mcqa_medmcqa": (
        "openlifescienceai/medmcqa",
        "med",
        "train",
        inputs.medical_table,
        dict(
            answer=LETTER.format("(p_partkey % 6 - 1)"),
            where="p_size % 2 = 0",
            context="case when p_partkey % 4 <> 0 then p_brand end",
        ),
    ),
}


def _adapted(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    name, subset, split, table, _ = SOURCES[key]
    return adapters.adapt(table(spark, sf_dir), origin(name, subset, split))


def _rows_sql(key: str) -> str:
    name, subset, _, _, options = SOURCES[key]
    return _sql(name, subset, **options)


@case(f"with {PARTS} {_rows_sql('mcqa_mmlu_aux')}")
def mcqa_mmlu_aux(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_adapted(spark, sf_dir, "mcqa_mmlu_aux"))


@case(f"with {PARTS} {_rows_sql('mcqa_mmlu')}")
def mcqa_mmlu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_adapted(spark, sf_dir, "mcqa_mmlu"))


@case(f"with {PARTS} {_rows_sql('mcqa_arc')}")
def mcqa_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_adapted(spark, sf_dir, "mcqa_arc"))


@case(f"with {PARTS} {_rows_sql('mcqa_scienceqa')}")
def mcqa_scienceqa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_adapted(spark, sf_dir, "mcqa_scienceqa"))


@case(f"with {PARTS} {_rows_sql('mcqa_mathqa')}")
def mcqa_mathqa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_adapted(spark, sf_dir, "mcqa_mathqa"))


@case(f"with {PARTS} {_rows_sql('mcqa_openbook')}")
def mcqa_openbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_adapted(spark, sf_dir, "mcqa_openbook"))


@case(f"with {PARTS} {_rows_sql('mcqa_sciq')}")
def mcqa_sciq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_adapted(spark, sf_dir, "mcqa_sciq"))


@case(f"with {PARTS} {_rows_sql('mcqa_medmcqa')}")
def mcqa_medmcqa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_adapted(spark, sf_dir, "mcqa_medmcqa"))


ALL_ROWS = " union all ".join(
    f"select *, '{subset}' as config, '{split}' as split from ({_rows_sql(key)})"
    for key, (_, subset, split, _, _) in SOURCES.items()
)


@case(f"with {PARTS} {ALL_ROWS}")
def mcqa_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [
        (table(spark, sf_dir), origin(name, subset, split))
        for name, subset, split, table, _ in SOURCES.values()
    ]
    everything = adapters.adapt_all(pairs)
    return everything.withColumn("choices", joined(F.col("choices")))


@case("select p_partkey, p_name, lower(p_type) as subject from part where lower(p_type) in ('economy', 'small')")
def stem_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = inputs.read(spark, sf_dir, "part").select(
        "p_partkey", "p_name", F.lower("p_type").alias("subject")
    )
    return mixture.allow_values(part, inputs.SUBJECTS, "subject")


@case(
    f"""with {PARTS} select p_partkey, array_to_string({MATH_CHOICES}, '|') as choices,
    len({MATH_CHOICES})::bigint as n from parts"""
)
def extract_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mcqa.packed_choices(F.col("options"))
    return inputs.math_table(spark, sf_dir).select(
        F.col("row_position").alias("p_partkey"),
        joined(found).alias("choices"),
        F.size(found).cast("bigint").alias("n"),
    )


@case(
    f"""with {PARTS} select 'math' as config, count(*) as n,
    count(*) filter (len({MATH_CHOICES}) < 6) as n_short from parts"""
)
def choice_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.short_choice_lists(_adapted(spark, sf_dir, "mcqa_mathqa"), 6)


HEADER = MCQA_HEADER.replace("\n", "' || chr(10) || '")
PROMPT = f"""'{HEADER}' || p_name || chr(10)
    || array_to_string(list_transform(range(0, 4),
         lambda i: chr((65 + i)::integer) || '. ' || choices[i + 1] || chr(10)), '')
    || 'Answer:'"""


@case(
    f"""with {PARTS}, keyed as (select *, {ARC_KEY} as answer from parts)
    select 'arc_' || p_partkey as id, {PROMPT} as prompt, ' A| B| C| D' as options,
           (ascii(answer) - 65)::bigint as correct_idx,
           ascii(answer) - 65 between 0 and 3 as valid, 'allenai/ai2_arc' as dataset
    from keyed"""
)
def mcqa_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = prompts(_adapted(spark, sf_dir, "mcqa_arc"), "id")
    return built.withColumn("options", joined(F.col("options"))).withColumn(
        "correct_idx", F.col("correct_idx").cast("bigint")
    )


@case(
    f"""with {PARTS}, placed as (
      select *, row_number() over (order by md5('42:book_' || pos), 'book_' || pos) - 1 as place,
             letters[(p_partkey % 4) + 1] as answer
      from parts)
    select (place // 8)::bigint as batch, string_agg({PROMPT}, '~' order by place) as prompts,
           string_agg((ascii(answer) - 65)::varchar, '|' order by place) as correct,
           string_agg(' A B C D', '|' order by place) as options
    from placed group by 1"""
)
def mcqa_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = prompt_batches(_adapted(spark, sf_dir, "mcqa_openbook"), 8)
    return built.select(
        "batch",
        F.array_join("prompt", "~").alias("prompts"),
        joined(F.col("correct_idx")).alias("correct"),
        joined(F.transform("options", lambda o: F.array_join(o, ""))).alias("options"),
    )


@case(
    f"""with {PARTS}, both_sets as (
      select case when pos % 4 = 0 then 'validation' else 'train' end as set, 'book' as config,
             'book_' || pos as id, {PROMPT} as prompt, letters[(p_partkey % 4) + 1] as answer from parts
      union all
      select case when p_partkey % 3 = 0 then 'validation' else 'train' end, 'arc', 'arc_' || p_partkey,
             {PROMPT}, {ARC_KEY} from parts),
    placed as (
      select *, row_number() over (partition by set
               order by md5('42:' || config || ':' || id), config, id) - 1 as place from both_sets)
    select set, (place // 8)::bigint as batch, string_agg(prompt, '~' order by place) as prompts,
           string_agg((ascii(answer) - 65)::varchar, '|' order by place) as correct
    from placed group by all"""
)
def question_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two datasets joined, for training and for validation, each set shuffled and collated."""
    number = F.substring_index("id", "_", -1).cast("bigint")
    book = _adapted(spark, sf_dir, "mcqa_openbook").withColumn("config", F.lit("book"))
    arc = _adapted(spark, sf_dir, "mcqa_arc").withColumn("config", F.lit("arc"))
    held = {"book": number % 4 == 0, "arc": number % 3 == 0}
    made = []
    for use, wanted in (("train", False), ("validation", True)):
        parts = [d.where(held[c] == wanted) for c, d in (("book", book), ("arc", arc))]
        made.append(prompt_batches(mixture.concat(parts), 8, ("config", "id")).withColumn("set", F.lit(use)))
    return mixture.concat(made).select(
        "set",
        "batch",
        F.array_join("prompt", "~").alias("prompts"),
        joined(F.col("correct_idx")).alias("correct"),
    )


@case(
    f"""with {PARTS} select 'arc_' || p_partkey as id, i::integer as option_idx,
    {PROMPT} || ' ' || chr((65 + i)::integer) as candidate from parts, range(4) r(i)"""
)
def option_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    exploded = candidates(prompts(_adapted(spark, sf_dir, "mcqa_arc"), "id"))
    return exploded.select("id", "option_idx", "candidate")


def book_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items to evaluate: prompts whose dataset is the brand, the more of them the larger the data.

    The rows of a question are few bytes, so that one split of the file holds many, and each of them
    becomes a row for every pair of tokens: they are dealt out."""
    built = prompts(_adapted(spark, sf_dir, "mcqa_openbook"), "id", "context")
    return built.repartition(shares(spark, sf_dir, "part")).select(
        F.col("id").alias("item"),
        F.col("context").alias("dataset"),
        F.col("correct_idx").alias("target"),
        "prompt",
        "options",
    )
