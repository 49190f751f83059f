"""Row-local expressions against hand-worked cases."""

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import chat, hashing, mcqa, text
from corpusmill.operators.scoring import cross_entropy
from corpusmill.schemas import MESSAGES

EOS = "<e>"


def one(spark, expression, **values):
    """Evaluate an expression over a single row; values are (value, type) pairs."""
    row = spark.range(1).select(
        *[F.lit(None).cast(t).alias(k) if v is None else _lit(spark, v, t).alias(k)
          for k, (v, t) in values.items()]
    )
    return row.select(expression.alias("x")).first()["x"]


def _lit(spark, value, kind):
    import json

    return F.from_json(F.lit(json.dumps({"v": value})), f"v {kind}")["v"]


def messages(spark, expression, rows):
    df = spark.createDataFrame([([{"role": r, "content": c} for r, c in rows],)], "m array<struct<role:string,content:string>>")
    return df.select(expression(F.col("m")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "rows, want",
    [
        ([("user", "hi"), ("assistant", "yo")], "hi\n\n<e>yo\n\n<e>"),
        ([("USER", "hi")], "hi\n\n<e>"),
        ([("system", "rules"), ("user", "hi")], "<e>hi\n\n<e>"),
        ([("tool", "x")], "<e>"),
        ([(None, "x"), ("user", None)], "<e>\n\n<e>"),
        ([("user", "  hi")], "hi\n\n<e>"),
        ([], ""),
    ],
)
def test_sft_text(spark, rows, want):
    assert messages(spark, lambda m: chat.sft_text(m, EOS), rows) == want


def test_sft_text_can_skip_other_roles(spark):
    rows = [("system", "rules"), ("user", "hi")]
    assert messages(spark, lambda m: chat.sft_text(m, EOS, skip_other_roles=True), rows) == "hi\n\n<e>"


def test_instruction_text_takes_the_first_of_each_role(spark):
    rows = [("system", "s"), ("assistant", "a1"), ("user", "u1"), ("user", "u2"), ("assistant", "a2")]
    want = "### Instruction:\nu1\n\n### Response:\na1"
    assert messages(spark, lambda m: chat.instruction_text(m), rows) == want
    assert messages(spark, lambda m: chat.instruction_text(m), []) == "### Instruction:\n\n\n### Response:\n"


def test_role_template(spark):
    rows = [("system", "s"), ("tool", "t"), ("user", "u")]
    body = "<s>system\ns<e>\n<s>user\nu<e>\n"
    assert messages(spark, lambda m: chat.role_template(m, "<s>", EOS), rows) == body
    assert messages(spark, lambda m: chat.role_template(m, "<s>", EOS, True), rows) == body + "assistant\n"
    assert messages(spark, lambda m: chat.role_template(m, "<s>", EOS, True), [("tool", "t")]) == "assistant\n"
    assert messages(spark, lambda m: chat.role_template(m, "<s>", EOS, True), []) == ""


def test_with_system(spark):
    def roles(m):
        return F.transform(chat.with_system(m), lambda x: x["role"])

    assert messages(spark, roles, [("user", "u")]) == ["system", "user"]
    assert messages(spark, roles, [("system", "s"), ("user", "u")]) == ["system", "user"]
    assert messages(spark, roles, []) == ["system"]


def test_nth_content_is_null_beyond_the_end(spark):
    assert messages(spark, lambda m: chat.nth_content(m, 1), [("user", "u")]) is None


def test_question_answer_matches_the_published_type(spark):
    df = spark.range(1).select(chat.question_answer(F.lit("q"), F.lit(None)).alias("m"))
    assert df.select(F.col("m").cast(MESSAGES)).first()[0] == [("user", "q"), ("assistant", None)]


@pytest.mark.parametrize(
    "value, want",
    [(" b ", 1), ("Z", 25), ("1", -16), ("", None), ("AB", None), (None, None), (" c", 2), ("ß", None)],
)
def test_answer_index(spark, value, want):
    assert one(spark, mcqa.answer_index(F.col("a")), a=(value, "string")) == want


@pytest.mark.parametrize("index, want", [(0, True), (3, True), (4, False), (-16, False), (None, False)])
def test_answer_valid(spark, index, want):
    choices = F.array(*[F.lit(c) for c in "wxyz"])
    assert one(spark, mcqa.answer_valid(F.col("i"), choices), i=(index, "int")) is want


@pytest.mark.parametrize("index, want", [(0, "A"), (3, "D"), (4, None), (-1, None), (None, None)])
def test_letter_at_never_wraps(spark, index, want):
    assert one(spark, mcqa.letter_at(F.col("i")), i=(index, "int")) == want


@pytest.mark.parametrize("letter, want", [("a", "A"), ("e", "E"), ("f", None), ("A", None), (None, None)])
def test_upper_letter(spark, letter, want):
    assert one(spark, mcqa.upper_letter(F.col("l")), l=(letter, "string")) == want


@pytest.mark.parametrize("n, shown", [(0, 0), (1, 1), (5, 5), (27, 26)])
def test_prompt_and_options_show_26_choices_at_most(spark, n, shown):
    choices = [f"c{i}" for i in range(n)]
    options = one(spark, mcqa.option_letters(F.col("c")), c=(choices, "array<string>"))
    assert options == [" " + chr(65 + i) for i in range(shown)]
    prompt = one(spark, mcqa.prompt(F.lit("q?"), F.col("c")), c=(choices, "array<string>"))
    lines = prompt.split("\n")
    assert lines[2] == "q?" and lines[-1] == "Answer:"
    assert lines[3:-1] == [f"{chr(65 + i)}. c{i}" for i in range(shown)]


@pytest.mark.parametrize(
    "packed, want",
    [
        ("a ) 5 , b ) x .", ["5", "x."]),
        ("a ) 1,000 , b ) 2", ["1", "2"]),
        ("a)x,b)y,c ) z", ["x", "y", "z"]),
        ("nothing here", []),
        ("", []),
    ],
)
def test_packed_choices(spark, packed, want):
    assert one(spark, mcqa.packed_choices(F.col("o")), o=(packed, "string")) == want


def test_first_index_prefers_the_first_equal_choice(spark):
    choices = F.array(F.lit("x"), F.lit("y"), F.lit("x"))
    assert one(spark, mcqa.first_index(choices, F.col("v")), v=("x", "string")) == 0
    assert one(spark, mcqa.first_index(choices, F.col("v")), v=("q", "string")) is None


def test_shuffled_repeats_and_keeps_all_choices(spark):
    choices = F.array(*[F.lit(c) for c in "abcd"])
    df = spark.range(200).select(mcqa.shuffled(choices, 42, F.col("id")).alias("s"))
    first = [r["s"] for r in df.collect()]
    again = [r["s"] for r in df.repartition(3).collect()]
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))
    assert all(sorted(s) == list("abcd") for s in first)
    assert len({tuple(s) for s in first}) > 15


@pytest.mark.parametrize(
    "value, thinking, content",
    [
        ("a</think>b", "a", "b"),
        ("a</think>b</think>\nc\n", "a</think>b", "c"),
        ("plain", "", "plain"),
        ("\nplain\n\n", "", "plain"),
        ("</think>x", "", "x"),
        ("x</think>", "x", ""),
    ],
)
def test_reasoning_split(spark, value, thinking, content):
    assert one(spark, text.reasoning_thinking(F.col("t")), t=(value, "string")) == thinking
    assert one(spark, text.reasoning_content(F.col("t")), t=(value, "string")) == content


def test_strip_removes_all_whitespace_at_the_ends(spark):
    assert one(spark, text.strip(F.col("t")), t=(" \t a b \n ", "string")) == "a b"


def test_tokens_and_their_count(spark):
    value = "Straße, 3rd-x über!"
    want = ["Straße", ",", "3rd", "-", "x", "über", "!"]
    assert one(spark, text.tokens(F.col("t")), t=(value, "string")) == want
    assert one(spark, text.token_count(F.col("t")), t=(value, "string")) == len(want)
    assert one(spark, text.token_count(F.col("t")), t=(None, "string")) == 0


@pytest.mark.parametrize(
    "value, want",
    [("AbC", ["abc"]), ("ab 12!cd", ["ab ", "b c", " cd"]), ("ab", []), ("", []), (None, []),
     ("a𝔘b c", None)],
)
def test_trigrams_of_letters(spark, value, want):
    found = one(spark, text.trigrams(text.letters_only(F.col("t"))), t=(value, "string"))
    if want is not None:
        assert found == want
    assert all(len(g) == 3 for g in found)


@pytest.mark.parametrize("size", [1, 3, 4, 50])
@pytest.mark.parametrize("value", ["", "ab", "abc", "abcdefg", "abcdefgh"])
def test_slices_hold_each_window_once(spark, value, size):
    cut = text.overlapping_slices(F.col("t"), size, 2)
    windows = F.flatten(F.transform(cut, text.trigrams))
    assert one(spark, windows, t=(value, "string")) == [value[i : i + 3] for i in range(len(value) - 2)]


def test_adjacent_pairs(spark):
    pairs = one(spark, text.adjacent_pairs(F.col("a")), a=(["x", "y", "z"], "array<string>"))
    assert [(p["prev"], p["cur"]) for p in pairs] == [("x", "y"), ("y", "z")]
    assert one(spark, text.adjacent_pairs(F.col("a")), a=(["x"], "array<string>")) == []
    assert one(spark, text.adjacent_pairs(F.col("a")), a=([], "array<string>")) == []


def test_draw_is_the_head_of_the_md5(spark):
    import hashlib

    want = int(hashlib.md5(b"42:7").hexdigest()[:8], 16)
    assert one(spark, hashing.draw(42, F.col("k")), k=(7, "bigint")) == want


def test_larger_fraction_keeps_earlier_choices(spark):
    df = spark.range(2000).select(
        hashing.chosen(0.05, 1, F.col("id")).alias("few"),
        hashing.chosen(0.2, 1, F.col("id")).alias("many"),
        hashing.chosen(1.0, 1, F.col("id")).alias("all"),
        hashing.chosen(0.0, 1, F.col("id")).alias("none"),
    )
    assert df.where("few and not many").count() == 0
    assert 60 < df.where("few").count() < 140
    assert df.where("not `all` or `none`").count() == 0


def test_cross_entropy_is_stable_and_null_for_a_bad_target(spark):
    import math

    def loss(logits, target):
        return one(
            spark, cross_entropy(F.col("l"), F.col("t")),
            l=(logits, "array<double>"), t=(target, "int"),
        )

    assert loss([1000.0, 1000.0], 0) == pytest.approx(math.log(2))
    assert loss([0.0, 1.0, 2.0], 1) == pytest.approx(
        math.log(1 + math.e + math.e**2) - 1
    )
    assert loss([1.0], 3) is None
