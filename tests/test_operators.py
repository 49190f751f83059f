"""Set-oriented operators: quirks, properties, and the paths taken only at scale."""

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.operators import (
    adapters,
    chunking,
    columns,
    conversations,
    distribution,
    langid,
    mixture,
    ordering,
    profile,
    sampling,
    scoring,
    skew,
    tokens,
)
from corpusmill.schemas import MCQA, conform
from corpusmill.session import stage

few = settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- columns and schemas -------------------------------------------------------------------


def test_rename_rejects_unknown_columns(spark):
    with pytest.raises(ValueError):
        columns.rename(spark.range(1), {"nope": "x"})
    assert columns.rename(spark.range(1), {"id": "x"}).columns == ["x"]


@pytest.mark.parametrize(
    "value, want",
    [("7", 7), ("3.0", 3), ("x", None), ("NaN", None), ("Infinity", None), ("99999999999", None),
     ("", None), (None, None)],
)
def test_to_int(spark, value, want):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(columns.to_int(F.col("v"))).first()[0] == want


def test_conform_rejects_missing_nested_fields(spark):
    from corpusmill.schemas import CHAT

    df = spark.sql("select '1' id, array(named_struct('role', 'user')) messages, 's' source")
    with pytest.raises(ValueError, match="content"):
        conform(df, CHAT)


# --- mixture -------------------------------------------------------------------------------


def sourced(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c")], "id long, source string")


def test_exclusion_keeps_null_sources_in_both_forms(spark):
    df = sourced(spark)
    denied = spark.createDataFrame([("a",), ("a",)], "source string")
    assert rows(mixture.exclude_sources(df, ["a"]).select("id")) == [(2,), (3,), (4,)]
    assert rows(mixture.exclude_listed(df, denied, "source").select("id")) == [(2,), (3,), (4,)]
    assert mixture.exclude_sources(df, []).count() == 4


def test_mapping_drops_unmapped_and_null_sources(spark):
    mapped = mixture.map_sources(sourced(spark), {"a": "x", "c": "x"})
    assert rows(mapped.select("id", "config")) == [(1, "x"), (4, "x")]
    assert mixture.map_sources(sourced(spark), {}).count() == 0


def test_concat_keeps_duplicates_and_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x")], "id long, t string")
    b = spark.createDataFrame([(2,)], "id long")
    assert mixture.concat([a, b]).collect().count((1, "x")) == 2
    assert (2, None) in [tuple(r) for r in mixture.concat([a, b]).collect()]
    with pytest.raises(ValueError):
        mixture.concat([])


def test_weights_above_one_repeat_rows(spark):
    df = spark.range(1000).withColumn("source", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    mixed = mixture.weighted_mix(df, {"a": 2.5, "b": 0.1}, ["id"], 1)
    copies = Counter(r["source"] for r in mixed.collect())
    assert 1150 < copies["a"] < 1350 and 25 < copies["b"] < 80
    per_row = Counter((r["id"], r["copy"]) for r in mixed.collect())
    assert max(per_row.values()) == 1
    assert mixed.where("source = 'a' and copy = 1").count() == 500


def test_funnel_counts_each_stage(spark):
    df = spark.createDataFrame([("a", 2), ("b", 2), (None, 2), ("b", 5)], "source string, n_messages int")
    stages = [
        ("kept", mixture.not_excluded(F.col("source"), ["a"])),
        ("two", F.col("n_messages") == 2),
    ]
    assert rows(profile.funnel(df, stages)) == [(0, "all", 4), (1, "kept", 3), (2, "two", 2)]


# --- conversations -------------------------------------------------------------------------


def hot_turns(spark, n=3000):
    """One conversation holds most rows; the rest have two messages."""
    big = spark.range(n).select(
        F.lit(0).cast("long").alias("conv"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("t"), F.col("id").cast("string")).alias("content"),
    )
    small = spark.range(100).select(
        (F.floor(F.col("id") / 2) + 1).alias("conv"), (F.col("id") % 2).alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("s"), F.col("id").cast("string")).alias("content"),
    )
    return big.unionByName(small).repartition(7)


def test_two_message_conversations(spark, plan_of):
    pairs = conversations.two_message(hot_turns(spark), ["conv"])
    got = {r["conv"]: [m["content"] for m in r["messages"]] for r in pairs.collect()}
    assert got == {k + 1: [f"s{2 * k}", f"s{2 * k + 1}"] for k in range(50)}
    plan = plan_of(pairs)
    assert "SortAggregate" not in plan and "LeftSemi" in plan  # longer ones never get gathered


def test_first_contents_equal_those_of_arrays(spark):
    from corpusmill.functions import chat

    turns = spark.createDataFrame(
        [(1, 0, "system", "s"), (1, 1, "assistant", "a1"), (1, 2, "user", "u1"), (1, 3, "assistant", "a2"),
         (2, 0, "user", None), (2, 1, "user", "u2"), (3, 5, "tool", "t")],
        "conv long, turn long, role string, content string",
    )
    firsts = conversations.first_contents(turns, ["conv"], {"u": "user", "a": "assistant", "f": None})
    m = F.col("messages")
    arrays = conversations.assemble(turns, ["conv"]).select(
        "conv", chat.first_content(m, "user"), chat.first_content(m, "assistant"), chat.nth_content(m, 0)
    )
    assert [tuple(r) for r in firsts.orderBy("conv").collect()] == [
        tuple(r) for r in arrays.orderBy("conv").collect()
    ]


def test_sft_text_of_turns_equals_that_of_arrays(spark):
    from corpusmill.functions import chat

    turns = hot_turns(spark)
    results = [rows(conversations.sft_text(turns, ["conv"], "<e>"))]
    arrays = conversations.assemble(turns, ["conv"]).select(
        "conv", chat.sft_text(F.col("messages"), "<e>").alias("text")
    )
    results.append(rows(arrays))
    # turns need an order only, so a text will do
    named = turns.withColumn("turn", F.format_string("t%09d", "turn"))
    results.append(rows(conversations.sft_text(named, ["conv"], "<e>")))
    assert results[0] == results[1] == results[2]
    assert results[0][0][1].startswith("t0\n\n<e>t1\n\n<e>t2") and len(results[0]) == 51


# --- order ---------------------------------------------------------------------------------


def test_shuffle_is_a_permutation_independent_of_partitions(spark):
    df = spark.range(500)
    first = [r["id"] for r in sampling.shuffle(df, ["id"], 7).collect()]
    again = [r["id"] for r in sampling.shuffle(df.repartition(5), ["id"], 7).collect()]
    assert first == again and sorted(first) == list(range(500)) and first != sorted(first)
    placed = ordering.hash_position(df.repartition(3), 7, ["id"], "p")
    assert [i for _, i in sorted((r["p"], r["id"]) for r in placed.collect())] == first


@pytest.mark.parametrize("n", [0, 1, 37, 500, 900])
def test_sample_n_is_the_head_of_the_shuffle(spark, n):
    df = spark.range(500).withColumn("text", F.lit("x"))
    head = [r["id"] for r in sampling.shuffle(df, ["id"], 7).collect()][:n]
    got = sorted((r["position"], r["id"]) for r in sampling.sample_n(df, n, ["id"], 7).collect())
    assert got == list(enumerate(head))


@pytest.mark.parametrize("fraction, size", [(0.0, 0), (0.05, 25), (0.333, 167), (1.0, 500)])
def test_exact_split_is_disjoint_complete_and_exact(spark, fraction, size):
    df = spark.range(500).withColumn("text", F.lit("x"))
    split = sampling.exact_split(df, ["id"], fraction, 7)
    assert split.count() == 500
    test = {r["id"] for r in split.where("split = 'test'").collect()}
    head = [r["id"] for r in sampling.shuffle(df, ["id"], 7).collect()][:size]
    assert test == set(head)


def test_exact_split_moves_no_rows(spark, plan_of, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert "Exchange" not in plan_of(sampling.exact_split(df, ["doc_id"]))


def test_split_keeps_a_row_on_its_side_when_rows_are_added(spark):
    label = sampling.split_label(["id"])
    few_rows = {r["id"]: r["s"] for r in spark.range(100).select("id", label.alias("s")).collect()}
    many = {r["id"]: r["s"] for r in spark.range(1000).select("id", label.alias("s")).collect()}
    assert all(many[k] == v for k, v in few_rows.items())


@pytest.mark.parametrize("shard_rows", [1, 7, 1 << 20])
def test_running_total(spark, shard_rows):
    values = [random.Random(1).randrange(10) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(values)), "p long, v long").repartition(4)
    got = {r["p"]: r["t"] for r in ordering.running_total(df, "p", "v", "t", shard_rows).collect()}
    assert got == {i: sum(values[:i]) for i in range(200)}


def grouped(spark):
    """Group 'hot' holds most rows, and most of those share one weight."""
    rng = random.Random(3)
    data = [("hot", i, 5 if i % 3 else rng.randrange(1, 50)) for i in range(400)]
    data += [(f"g{i % 20}", 1000 + i, rng.randrange(1, 50)) for i in range(100)]
    data += [(None, 2000 + i, rng.randrange(1, 50)) for i in range(200)]
    return spark.createDataFrame(data, "g string, k long, w long").repartition(5), data


def nucleus(data, p):
    groups = defaultdict(list)
    for g, k, w in data:
        groups[g].append((-w, k))
    kept = set()
    for g, items in groups.items():
        total, before = sum(-w for w, _ in items), 0
        for w, k in sorted(items):
            if before <= p * total:
                kept.add(k)
            before -= w
    return kept


@pytest.mark.parametrize("rows_in_range", [7, 1 << 17])
@pytest.mark.parametrize("p", [0.0, 0.6, 1.0])
def test_top_p_however_the_table_is_cut(spark, rows_in_range, p):
    df, data = grouped(spark)
    got = distribution.top_p(df, "g", "w", ["k"], p, range_rows=rows_in_range)
    assert {r["k"] for r in got.collect()} == nucleus(data, p)
    assert got.count() == len(nucleus(data, p))


def test_fractional_weights_give_the_same_rows_for_any_partition_count(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 7).alias("g"),
        F.col("id").alias("k"),
        (F.rand(5) * 3).alias("w"),
    )
    df = stage(df, "weights")
    found = [
        (
            rows(distribution.top_p(part, "g", "w", ["k"], 0.4, range_rows=n)),
            rows(distribution.softmax(part, "g", "w")),
        )
        for part, n in ((df.coalesce(1), 100), (df.repartition(3), 1000), (df.repartition(11), 1 << 17))
    ]
    assert found[0] == found[1] == found[2] and len(found[0][1]) == 3000


def test_softmax(spark):
    import math

    df, data = grouped(spark)
    got = distribution.softmax(df, "g", "w", temperature=2.0)
    sums = defaultdict(float)
    for g, _, w in data:
        sums[g] += math.exp(w / 2)
    want = {k: math.exp(w / 2) / sums[g] for g, k, w in data}
    found = {r["k"]: r["probability"] for r in got.collect()}
    assert found.keys() == want.keys()
    assert all(found[k] == pytest.approx(want[k]) for k in want)


def test_weighted_draw_follows_the_weights(spark):
    df = spark.range(4000).select(
        F.floor(F.col("id") / 2).alias("g"), F.col("id").alias("k"),
        F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("w"),
    )
    drawn = distribution.weighted_draw(df, "g", F.col("w"), ["k"])
    assert drawn.count() == 2000
    assert 1400 < drawn.where("k % 2 = 0").count() < 1600
    none = df.withColumn("w", F.when(F.col("k") % 2 == 0, 0.0).otherwise(1.0))
    assert distribution.weighted_draw(none, "g", F.col("w"), ["k"]).where("k % 2 = 0").count() == 0


# --- lookups -------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [0, 200, 600, 1 << 20])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_beyond_the_broadcast_limit(spark, limit, how):
    table = spark.createDataFrame(
        [(f"k{i}", i, 1 << max(0, 12 - i)) for i in range(30)], "key string, v int, heat long"
    )
    facts = [(n, "k0") for n in range(500)] + [(500 + i, f"k{i}") for i in range(30)]
    facts += [(900, "unknown"), (901, None), (902, None)]
    df = spark.createDataFrame(facts, "n long, key string").repartition(6)
    got = skew.lookup_join(df, table, ["key"], "heat", how, limit)
    values = {f"k{i}": i for i in range(30)}
    want = [(n, k, values.get(k)) for n, k in facts if how == "left" or k in values]
    have = [(r["n"], r["key"], r["v"]) for r in got.collect()]
    assert sorted(have, key=str) == sorted(want, key=str)


def test_hot_level_keeps_within_the_limit(spark):
    table = spark.range(1, 1000).select(F.col("id").alias("heat"))
    row = skew.ROW_OVERHEAD + 8
    for limit in (0, row, 500 * row, 900 * row, 5000 * row):
        level = skew.hot_level(table, "heat", limit)
        hot = table.where(F.length(F.bin("heat")) >= level).count()
        assert hot * row <= limit
    assert skew.hot_level(table, "heat", 5000 * row) == 1


def test_long_texts_count_towards_the_broadcast_limit(spark, plan_of):
    table = spark.createDataFrame([("a", 1, 9), ("b" * 5000, 2, 1)], "key string, v int, heat long")
    facts = spark.createDataFrame([("a",), ("b" * 5000,), ("c",)], "key string")
    got = skew.lookup_join(facts, table, ["key"], "heat", "left", 1000)
    assert sorted((len(r["key"]), r["v"]) for r in got.collect() if r["v"]) == [(1, 1), (5000, 2)]
    assert "_salt" in plan_of(got) and "Union" not in plan_of(got)


def test_a_frequent_key_that_the_table_lacks_is_shared_by_many_tasks(spark):
    table = spark.createDataFrame([(f"k{i}", i, 1) for i in range(100)], "key string, v int, heat long")
    facts = spark.range(4000).select(
        F.col("id").alias("n"), F.when(F.col("id") % 2 == 0, "lacking").otherwise("k7").alias("key")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = skew.lookup_join(facts, table, ["key"], "heat", "left", 0, salts=32)
        placed = got.select("key", "v", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(placed) == 4000 and all(r["v"] == (7 if r["key"] == "k7" else None) for r in placed)
    assert len({r["p"] for r in placed if r["key"] == "lacking"}) >= 7


# --- adapters ------------------------------------------------------------------------------


def origin(name="cais/mmlu", subset="m"):
    return adapters.Origin(name, subset, "train", ["physics"])


def test_ids_keep_the_gaps_of_the_filter_and_bad_indexes_are_null(spark):
    df = spark.createDataFrame(
        [(0, "physics", "q0", ["x"], 0), (1, "art", "q1", ["x"], 1), (2, "physics", "q2", ["x"], 9)],
        "row_position long, subject string, question string, choices array<string>, answer int",
    )
    got = adapters.mmlu(df, origin())
    assert [(r["id"], r["answer"]) for r in got.orderBy("id").collect()] == [("m_0", "A"), ("m_2", None)]
    assert got.schema == conform(got, MCQA).schema


def test_medical_indexes_never_wrap(spark):
    df = spark.createDataFrame(
        [(i, "q", "a", "b", "c", "d", cop, kind, None)
         for i, (cop, kind) in enumerate([(-1, "single"), (0, "single"), (3, "single"), (4, "single"),
                                          (1, "multi"), (1, None)])],
        "row_position long, question string, opa string, opb string, opc string, opd string, cop int,"
        " choice_type string, exp string",
    )
    got = adapters.med_mcqa(df, origin("openlifescienceai/medmcqa", "med"))
    assert [r["answer"] for r in got.orderBy("id").collect()] == [None, "A", "D", None]


def test_science_filter(spark):
    df = spark.createDataFrame(
        [(0, None, "natural science", "closed choice"), (1, "img", "natural science", "closed choice"),
         (2, None, "social science", "closed choice"), (3, None, "natural science", "open"),
         (4, None, None, "closed choice")],
        "row_position long, image string, subject string, task string",
    ).withColumns({"question": F.lit("q"), "choices": F.array(F.lit("x")), "answer": F.lit(0)})
    got = adapters.science_qa(df, origin("derek-thomas/ScienceQA", "s"))
    assert [r["id"] for r in got.collect()] == ["s_0"]


def test_sciq_letter_always_points_at_the_answer(spark):
    df = spark.range(300).select(
        F.col("id").alias("row_position"), F.lit("q").alias("question"),
        F.lit("x").alias("distractor1"),
        F.when(F.col("id") % 3 == 0, "right").otherwise("y").alias("distractor2"),
        F.lit("z").alias("distractor3"), F.lit("right").alias("correct_answer"),
        F.lit("s").alias("support"),
    )
    got = adapters.sciq(df, origin("allenai/sciq", "q")).collect()
    for r in got:
        at = "ABCD".index(r["answer"])
        assert r["choices"][at] == "right" and "right" not in r["choices"][:at]
    assert {r["answer"] for r in got} == set("ABCD")


def test_unknown_dataset_raises(spark):
    with pytest.raises(ValueError, match="no adapter"):
        adapters.adapt(spark.range(1), origin("who/knows"))


# --- language ------------------------------------------------------------------------------


def language_model(spark):
    data = [("en", "the cat and the dog"), ("en", "this is the thing"), ("fr", "le chat et le chien"),
            ("fr", "ceci est la chose")]
    return langid.train(spark.createDataFrame(data, "lang string, text string"))


def test_language_detection_and_texts_without_letters(spark):
    model = language_model(spark)
    texts = [(0, "the dog is the thing"), (1, "le chien est la"), (2, "ab"), (3, ""), (4, None), (5, "12 34")]
    df = spark.createDataFrame(texts, "k long, t string")
    for limit in (0, 800, 1 << 20):
        got = {r["k"]: r["lang"] for r in langid.detect(df, ["k"], "t", model, limit).collect()}
        assert got == {0: "en", 1: "fr", 2: None, 3: None, 4: None, 5: None}


def test_scores_do_not_depend_on_the_join_path(spark):
    model = language_model(spark)
    df = spark.createDataFrame([(i, "the chat " * (i + 1)) for i in range(20)], "k long, t string")
    paths = [rows(langid.detect(df, ["k"], "t", model, n)) for n in (0, 800, 1 << 20)]
    assert paths[0] == paths[1] == paths[2]


def test_only_language_judges_each_row(spark):
    model = language_model(spark)
    df = spark.createDataFrame(
        [
            ("all", [("user", "the dog"), ("assistant", "this is the thing")]),
            ("one", [("user", "the dog"), ("assistant", "le chien est la")]),
            ("empty", []),
            ("short", [("user", "the dog"), ("assistant", "no")]),
            ("null", [("user", None)]),
            (None, [("user", "le chien est la")]),
            (None, [("user", "this is the dog")]),
            ("all", [("user", "le chien est la")]),
        ],
        "id string, messages array<struct<role:string,content:string>>",
    )
    kept = langid.only_language(df, model).select("id", F.size("messages").alias("n"))
    got = sorted(rows_of(kept), key=str)
    assert got == [("all", 2), ("empty", 0), (None, 1)]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_repeated_rows_are_detected_one_by_one(spark):
    model = language_model(spark)
    df = spark.createDataFrame(
        [(1, "this is the dog"), (1, "this is the dog"), (1, "le chien est la"), (None, "le chien"), (2, None)],
        "k long, t string",
    )
    got = rows_of(langid.detect(df, ["k"], "t", model))
    one = [r for r in got if r[0] == 1]
    assert len(got) == 5 and sorted(r[3] for r in one) == ["en", "en", "fr"]
    assert len({r[1:] for r in one if r[3] == "en"}) == 1
    assert [r[3] for r in got if r[0] is None] == ["fr"] and [r[1:] for r in got if r[0] == 2] == [(0, None, None)]


# --- tokens --------------------------------------------------------------------------------


def test_vocabulary_ranks_by_frequency(spark):
    words = ["a"] * 700 + ["b"] * 300 + ["c"] * 300 + ["d"] * 2 + [f"r{i}" for i in range(50)]
    df = spark.createDataFrame([(" ".join(words),)], "text string").repartition(3)
    vocab = {r["token"]: (r["n"], r["token_id"]) for r in tokens.build_vocab(df).collect()}
    assert vocab["a"] == (700, tokens.FIRST_ID)
    assert {vocab["b"][1], vocab["c"][1]} == {4, 5} and vocab["d"] == (2, 6)
    assert sorted(i for _, i in vocab.values()) == list(range(3, 3 + 54))


@pytest.mark.parametrize("limit", [0, 120, 1 << 20])
def test_encoding_keeps_order_unknowns_and_empty_texts(spark, limit):
    vocab = stage(tokens.build_vocab(spark.createDataFrame([("x x x y y z",)], "text string")), "v")
    df = spark.createDataFrame(
        [(0, "z x y x", "x"), (1, "", None), (2, "x new x", "y y")], "k long, a string, b string"
    )
    got = tokens.encode(df, ["k"], {"ia": "a", "ib": "b"}, vocab, limit)
    have = {r["k"]: (r["ia"], r["ib"]) for r in got.collect()}
    assert have == {0: ([5, 3, 4, 3], [3]), 1: ([], []), 2: ([3, 1, 3], [4, 4])}


def test_truncate_and_pad(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],), ([9],), ([],)], "ids array<bigint>")
    ids = F.col("ids")
    right, left = tokens.truncate(ids, 3), tokens.truncate(ids, 3, "left")
    got = df.select(right, left, tokens.pad(right, 3), tokens.pad(left, 3, "right"), tokens.attention_mask(right, 3)).collect()
    assert [list(r) for r in got] == [
        [[1, 2, 3], [2, 3, 4], [1, 2, 3], [2, 3, 4], [1, 1, 1]],
        [[9], [9], [0, 0, 9], [9, 0, 0], [0, 0, 1]],
        [[], [], [0, 0, 0], [0, 0, 0], [0, 0, 0]],
    ]


@few
@given(st.lists(st.integers(0, 25), min_size=1, max_size=30), st.integers(1, 12))
def test_packing_preserves_tokens_and_fills_blocks(spark, sizes, length):
    data = [(i, [100 * i + j for j in range(n)]) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(data, "p long, ids array<bigint>").repartition(3)
    blocks = sorted((r["block"], r["input_ids"]) for r in tokens.pack(df, "p", "ids", length).collect())
    want = [t for _, ids in data for t in [*ids, tokens.EOS]]
    assert [t for _, b in blocks for t in b] == want
    assert all(len(b) == length for _, b in blocks[:-1])
    assert [b for b, _ in blocks] == list(range(len(blocks)))


def test_batches_are_parallel_lists(spark):
    df = spark.range(10).select(F.col("id").alias("p"), (F.col("id") * 2).alias("v")).repartition(4)
    got = rows(tokens.batches(df, "p", ["p", "v"], 4))
    assert got == [(0, [0, 1, 2, 3], [0, 2, 4, 6]), (1, [4, 5, 6, 7], [8, 10, 12, 14]), (2, [8, 9], [16, 18])]


@few
@given(st.text(alphabet="ab#\n -_*`", max_size=200), st.integers(1, 50))
def test_chunks_add_up_to_the_text(spark, value, size):
    df = spark.createDataFrame([(1, value)], "k long, text string")
    got = chunking.chunk_documents(df, ["k"], "text", size).orderBy("chunk").collect()
    assert "".join(r["text"] for r in got) == value
    assert all(0 < len(r["text"]) <= size for r in got)


def test_chunks_cut_at_the_strongest_separator(spark):
    df = spark.createDataFrame(
        [
            (1, "intro\n# one\n\ntext\n## two\nmore"),
            (2, "p one here\n\np two"),
            (3, "abcdefgh" * 2),
            (4, "ab\ufdd0cd\n\nef"),
            (5, None),
        ],
        "k long, text string",
    )
    got = chunking.chunk_documents(df, ["k"], "text", 12).orderBy("k", "chunk").collect()
    by_key = defaultdict(list)
    for r in got:
        by_key[r["k"]].append(r["text"])
    assert by_key == {
        1: ["intro", "\n# one\n\ntext", "\n## two\nmore"],
        2: ["p one here", "\n\np two"],
        3: ["abcdefghabcd", "efgh"],
        4: ["ab\ufdd0cd\n\nef"],
    }


# --- scoring -------------------------------------------------------------------------------


def test_ties_go_to_the_lowest_option_and_bad_targets_are_wrong(spark):
    scores = spark.createDataFrame(
        [(1, "d", 1, 0, 0.5), (1, "d", 1, 1, 0.9), (1, "d", 1, 2, 0.9), (2, "d", -16, 0, 1.0), (3, "e", None, 0, 1.0)],
        "item long, dataset string, target int, option_idx int, score double",
    )
    got = {r["item"]: (r["pred"], r["is_correct"]) for r in scoring.argmax_option(scores).collect()}
    assert got == {1: (1, True), 2: (0, False), 3: (0, False)}


def test_accuracy_of_nothing_is_zero(spark):
    empty = spark.createDataFrame([], "item long, dataset string, target int, pred int, is_correct boolean")
    got = scoring.accuracy_with_total(empty).collect()
    assert [tuple(r) for r in got] == [(None, 0, 0, 0.0, True)]
    assert rows(scoring.metrics_long(scoring.accuracy_with_total(empty))) == [("accuracy", 0.0)]


def test_items_without_a_dataset_are_a_group_and_not_the_total(spark):
    predictions = spark.createDataFrame(
        [(1, None, True), (2, None, False), (3, "d", False)], "item long, dataset string, is_correct boolean"
    )
    metrics = scoring.metrics_long(scoring.accuracy_with_total(predictions))
    got = {r["metric"]: round(r["value"], 3) for r in metrics.collect()}
    assert got == {"accuracy": 0.333, "accuracy_null": 0.5, "accuracy_d": 0.0} and metrics.count() == 3


def test_items_without_options_stay_and_count_as_wrong(spark):
    from corpusmill.plans.evaluation import evaluate

    model = scoring.train_bigrams(spark.createDataFrame([("a b a b c",)], "text string"))
    items = spark.createDataFrame(
        [(1, "d", 0, "a", ["b", "c"]), (2, "d", 0, "a", []), (3, "d", 0, "a", None)],
        "item long, dataset string, target int, prompt string, options array<string>",
    )
    scores = scoring.score_options(items, ["item"], model).collect()
    assert sorted((r["item"], r["option_idx"], r["score"] is None) for r in scores if r["item"] > 1) == [
        (2, None, True),
        (3, None, True),
    ]
    metrics = {r["metric"]: r["value"] for r in evaluate(items, model).collect()}
    assert metrics["accuracy"] == pytest.approx(1 / 3)


def test_ragged_options_are_scored(spark):
    scores = spark.createDataFrame(
        [(1, 0, 0.1), (1, 1, 0.2), (2, 2, 0.3), (2, 0, 0.1), (2, 1, 0.2)], "item long, option_idx int, score double"
    )
    got = {r["item"]: r["logits"] for r in scoring.options_to_logits(scores, ["item"]).collect()}
    assert got == {1: [0.1, 0.2], 2: [0.1, 0.2, 0.3]}


def bigram_reference(corpus, prompt, option, scale):
    import math
    import re

    pairs, contexts, words = Counter(), Counter(), set()
    for text in corpus:
        t = re.findall(r"\w+|[^\w\s]", text)
        for a, b in zip(t, t[1:]):
            pairs[a, b] += 1
            contexts[a] += 1
            words |= {a, b}
    t = re.findall(r"\w+|[^\w\s]", prompt) + re.findall(r"\w+|[^\w\s]", option)
    logp = sum(math.log((pairs[p] + 1) / (contexts[p[0]] + len(words))) for p in zip(t, t[1:]))
    if len(t) < 2:
        return 0.0
    return logp * (len(t) if scale == "reference" else len(t) - 1) / (len(t) - 1)


@pytest.mark.parametrize("scale", ["reference", "sum"])
@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_bigram_scores_against_brute_force(spark, scale, limit):
    corpus = ["the answer is a b", "the answer is b", "a question : b b", "one"]
    model = scoring.train_bigrams(spark.createDataFrame([(c,) for c in corpus], "text string"))
    items = [("i1", "the answer is", [" a", " b", " new word"]), ("i2", "", [" a", " a b"]), ("i3", "x :", [" b"])]
    df = spark.createDataFrame(items, "item string, prompt string, options array<string>")
    got = scoring.score_options(df, ["item"], model, scale, limit)
    have = {(r["item"], r["option_idx"]): r["score"] for r in got.collect()}
    want = {
        (i, n): bigram_reference(corpus, p, o, scale) for i, p, opts in items for n, o in enumerate(opts)
    }
    assert have.keys() == want.keys()
    assert all(have[k] == pytest.approx(want[k], abs=1e-4) for k in want)


def test_a_callers_model_scores_candidates(spark):
    def make():
        import numpy as np

        return lambda texts: np.array([float(len(t)) for t in texts])

    items = spark.createDataFrame(
        [("i", "d", 1, "p:", [" a", " longer"])],
        "item string, dataset string, target int, prompt string, options array<string>",
    )
    from corpusmill.plans.evaluation import evaluate_with

    assert rows(evaluate_with(items, make)) == [("accuracy", 1.0), ("accuracy_d", 1.0)]


# --- growth --------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [0, 1 << 20])
@pytest.mark.parametrize("block_bytes", [1, 40, 1 << 20])
def test_encoding_looks_up_each_token_of_a_block_once(spark, monkeypatch, limit, block_bytes):
    seen, join = [], tokens.lookup_join
    monkeypatch.setattr(tokens, "lookup_join", lambda facts, *a, **b: seen.append(facts.count()) or join(facts, *a, **b))
    vocab = stage(tokens.build_vocab(spark.createDataFrame([("x x x y y z",)], "text string")), "v")
    data = [(k, "x y . " * 50, None if k % 3 else "z new") for k in range(12)] + [(None, "z", "")]
    df = spark.createDataFrame(data, "k long, a string, b string")
    got = tokens.encode(df, ["k"], {"ia": "a", "ib": "b"}, vocab, limit, block_bytes)
    have = {r["k"]: (r["ia"], r["ib"]) for r in got.collect()}
    assert have == {
        None: ([5], []),
        **{k: ([3, 4, 1] * 50, [] if k % 3 else [5, 1]) for k in range(12)},
    }
    assert seen[0] <= 13 * 5  # 1,809 tokens


def test_encoding_merges_rows_that_share_their_keys(spark):
    vocab = stage(tokens.build_vocab(spark.createDataFrame([("x x x y y z",)], "text string")), "v")
    df = spark.createDataFrame([(1, "z x"), (1, "x y y"), (None, "y"), (None, None)], "k long, a string")
    got = {r["k"]: r["ids"] for r in tokens.encode(df, ["k"], {"ids": "a"}, vocab).collect()}
    assert got == {1: [3, 5, 3, 4, 4], None: [4]}


def test_packing_orders_few_rows_with_their_ids_at_a_time(spark, monkeypatch):
    """Rows, most of them in a million-row shard before, come in shards that a task can hold."""
    from corpusmill.operators import packing

    taken = []
    for module, name, at in ((tokens, "running_total", 4), (packing, "position_in_group", 4)):
        plain = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, f=plain, at=at: taken.append(a[at]) or f(*a))
    data = [(i, [i] * (i % 7)) for i in range(50)]
    df = spark.createDataFrame(data, "p long, ids array<bigint>").repartition(3)
    monkeypatch.setattr(tokens, "ID_ROWS", 8)
    monkeypatch.setattr(packing, "ID_ROWS", 8)
    cut = sorted((r["block"], r["input_ids"]) for r in tokens.pack(df, "p", "ids", 16).collect())
    assert [x for _, b in cut for x in b] == [x for _, ids in data for x in [*ids, tokens.EOS]]
    whole = [x for r in packing.pack_whole(df, "p", "ids", 16).collect() for x in r["input_ids"]]
    assert sorted(whole) == sorted(x for _, ids in data for x in [*ids, tokens.EOS])
    assert taken == [8, 32]


def test_the_bigram_model_counts_words_without_a_pass_over_all_pairs(spark, monkeypatch):
    staged, plain = [], scoring.stage
    monkeypatch.setattr(scoring, "stage", lambda df, label: staged.append(label) or plain(df, label))
    texts = ["a b a b c", "c", "d", "e f", "f", None, ""]
    model = scoring.train_bigrams(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert staged == ["pairs", "contexts"]  # no table of prices for pairs that nobody asks for
    assert model.vocabulary == 5  # "c" and "f" only end texts, "d" is never in a pair
    got = {(r["prev"], r["cur"]): (r["n"], r["n_prev"]) for r in model.table().collect()}
    assert got == {("a", "b"): (2, 2), ("b", "a"): (1, 2), ("b", "c"): (1, 2), ("e", "f"): (1, 1)}


def test_heavy_rows_are_dealt_out_by_the_size_of_their_table(spark, tmp_path):
    from workload.inputs import read_wide, shares
    from workload.questions import book_items

    cores = spark.sparkContext.defaultParallelism
    assert book_items(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= cores
    spark.range(4000).repartition(40).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", 128 << 20)  # a split for each file
    try:
        assert shares(spark, str(tmp_path), "documents") == 160
        assert read_wide(spark, str(tmp_path), "documents").rdd.getNumPartitions() == 160
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_positions_in_groups_need_one_exchange_of_the_rows(spark, plan_of):
    data = [(i, None if i % 5 == 0 else i % 3, "x" * i) for i in range(60)]
    df = spark.createDataFrame(data, "p long, g int, wide string").repartition(3)
    got = ordering.position_in_group(df, "p", "g", "place", 7)
    seen, want = Counter(), {}
    for p, g, _ in data:
        want[p] = seen[g]
        seen[g] += 1
    assert {r["p"]: r["place"] for r in got.collect()} == want
    assert got.columns == ["p", "g", "wide", "place"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        lines = plan_of(ordering.position_in_group(df, "p", "g", "place", 7)).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("Exchange hashpartitioning" in x for x in lines) <= 4  # of the rows, and of their counts
