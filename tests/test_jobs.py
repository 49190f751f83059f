"""Sources, sinks, streams and whole jobs."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import chat
from corpusmill.operators.sampling import percent_sample
from corpusmill.plans import recipe as recipes
from corpusmill.plans.chat_mixture import build_mixture_from
from corpusmill.plans.corpus import build_corpus, publish
from corpusmill.plans.questions import build_questions, prompts
from corpusmill.plans.training_text import (
    build_training_text,
    build_training_text_from,
    questions_to_chat,
)
from corpusmill.schemas import PREFERENCES_RAW
from corpusmill.sources import sinks, tables
from corpusmill.streaming.sample import save_percent_sample


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def chats(spark, n, source="s", start=0):
    return spark.range(start, start + n).select(
        F.col("id").cast("string").alias("id"),
        chat.question_answer(
            F.concat(F.lit("q"), F.col("id").cast("string")), F.lit("a")
        ).alias("messages"),
        F.lit(source).alias("source"),
    )


# --- scans ---------------------------------------------------------------------------------


def test_row_positions_over_several_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 1000, 1, 7).select("id").write.parquet(path)
    placed = tables.with_row_position(spark.read.parquet(path))
    assert rows(placed) == [(i, i) for i in range(1000)]
    after = placed.where("id % 10 = 3")
    assert all(r["id"] == r["row_position"] for r in after.collect())


def test_row_positions_with_many_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 100, 1, 9).write.parquet(path)
    placed = tables.with_row_position(spark.read.parquet(path), range_rows=2)
    assert rows(placed) == [(i, i) for i in range(100)]


@pytest.mark.parametrize("percent, n", [(0, 0), (1, 2), (50, 125), (100, 250)])
def test_head_percent(spark, tmp_path, percent, n):
    path = str(tmp_path / "t")
    spark.range(0, 250, 1, 3).write.parquet(path)
    assert rows(tables.head_percent(spark.read.parquet(path), percent)) == [(i,) for i in range(n)]


def test_json_array_files(spark, tmp_path):
    data = [
        {"course_id": "1", "question_id": 7, "question_body": "q", "question_answer": None, "question_type": "open", "extra": 1},
        {"course_id": "x", "question_id": "8.0", "question_body": "q2", "question_answer": "a2", "question_type": "open"},
    ]
    (tmp_path / "a.json").write_text(json.dumps(data, indent=1))
    (tmp_path / "b.json").write_text(json.dumps(data[:1]))
    raw = tables.scan_json_array(spark, str(tmp_path), PREFERENCES_RAW)
    got = questions_to_chat(raw, "local")
    assert rows(got.select("id")) == [("local_1_7",), ("local_1_7",), ("local_null_8",)]
    texts = got.select(chat.sft_text(F.col("messages"), "<e>")).collect()
    assert ("q\n\n<e>\n\n<e>",) in [tuple(t) for t in texts]


# --- sinks ---------------------------------------------------------------------------------


def published(spark, path):
    df = spark.range(2000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("c"), (F.col("id") % 5).cast("string"))).alias("config"),
        F.when(F.col("id") % 20 == 0, "test").otherwise("train").alias("split"),
    )
    sinks.write_splits(df, path)
    return df


def test_write_and_read_back(spark, tmp_path, plan_of):
    path = str(tmp_path / "t")
    df = published(spark, path)
    back = spark.read.parquet(path)
    assert rows(back.select("id", "config", "split")) == rows(df)
    part = tables.scan_split(spark, path, "big", "test")
    assert rows(part.select("id")) == rows(df.where("config = 'big' and split = 'test'").select("id"))
    assert "PartitionFilters: [isnotnull(config" in plan_of(part)
    assert tables.scan_split(spark, path, None, "validation").count() == 0
    assert rows(tables.list_splits(back)) == rows(df.select("config", "split").distinct())


def test_all_is_a_view(spark, tmp_path):
    path = str(tmp_path / "t")
    df = published(spark, path)
    everything = sinks.scan_published(spark, path, "all", "train")
    assert everything.count() == df.where("split = 'train'").count()
    assert rows(everything.select("config").distinct()) == [("all",)]
    both = sinks.with_all_config(spark.read.parquet(path))
    assert both.count() == 2 * df.count()
    assert not (Path(path) / "config=all").exists()
    assert sinks.scan_published(spark, path, "big", None).count() == df.where("config = 'big'").count()


def test_writing_never_overwrites_by_default(spark, tmp_path):
    path = str(tmp_path / "t")
    published(spark, path)
    with pytest.raises(Exception, match="already exists"):
        published(spark, path)


def test_large_partitions_get_several_files(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(1000).select("id", F.lit("one").alias("config"), F.lit("train").alias("split"))
    sinks.write_splits(df, path, max_records_per_file=100)
    assert len(list(Path(path).rglob("*.parquet"))) == 10


# --- stream --------------------------------------------------------------------------------


def test_stream_sample_equals_batch_and_resumes(spark, tmp_path):
    source, out, progress = (str(tmp_path / d) for d in ("in", "out", "progress"))
    spark.range(0, 3000, 1, 3).withColumn("text", F.lit("x")).write.parquet(source)
    schema = spark.read.parquet(source).schema

    def run():
        stream = tables.scan_stream(spark, source, schema)
        save_percent_sample(
            stream, 10, ["id"], out, progress, transform=lambda d: d.withColumn("n", F.length("text")),
            timeout=120,
        )
        return rows(tables.scan_saved(spark, out).select("id"))

    def want():
        return rows(percent_sample(spark.read.parquet(source), 10, ["id"]).select("id"))

    assert run() == want()
    assert run() == want()
    spark.range(3000, 4000).withColumn("text", F.lit("y")).write.mode("append").parquet(source)
    assert run() == want()


# --- recipes -------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["questions", "chat_mixture", "chat_corpus"])
def test_shipped_recipes_load(name):
    path = Path(__file__).resolve().parent.parent / "recipes" / f"{name}.yaml"
    assert recipes.load_recipe(str(path))["datasets"]


def test_unknown_recipe_keys_raise(tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"datasets": [{"name": "x", "column_mapping": {}}]}))
    with pytest.raises(ValueError, match="column_mapping"):
        recipes.load_recipe(str(path))


def test_corpus_job(spark, tmp_path):
    root = str(tmp_path / "raw")
    table = chats(spark, 20).withColumnRenamed("messages", "talk")
    sinks.write_splits(table.withColumns({"config": F.lit("default"), "split": F.lit("train")}), root)
    recipe = {
        "output_path": str(tmp_path / "out"),
        "shuffle": True,
        "datasets": [
            {"name": "one", "path": root, "config": "default", "rename": {"talk": "messages"},
             "columns": ["id", "messages"], "subset": "first"},
            {"name": "two", "path": root, "config": "default", "columns": ["id"]},
        ],
    }
    publish(build_corpus(spark, recipes.checked(recipe)), recipe)
    back = spark.read.parquet(recipe["output_path"])
    assert rows(back.groupBy("config", "split").count()) == [("first", "train", 20), ("two", "train", 20)]
    assert back.where("config = 'two' and messages is not null").count() == 0


def test_mixture_job(spark, tmp_path):
    root, local = str(tmp_path / "raw"), str(tmp_path / "local")
    three = chats(spark, 3, "math", 500).withColumn(
        "messages", F.concat("messages", F.slice("messages", 1, 1))
    )
    parts = [chats(spark, 5, "math"), chats(spark, 4, "bad", 100), chats(spark, 2, "other", 200),
             chats(spark, 6, None, 300), three]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    sinks.write_splits(table.withColumns({"config": F.lit("default"), "split": F.lit("train")}), root)
    chats(spark, 7, "local", 900).write.parquet(local)
    entries = [
        {"name": "m", "path": root, "source_map": {"math": "m", "bad": "b"}, "exclude": ["bad"]},
        {"name": "l", "path": local, "layout": "plain", "subset": "mine"},
    ]
    built = build_mixture_from(spark, recipes.checked({"datasets": entries}))
    assert rows(built.groupBy("config", "split").count()) == [("m", "train", 5), ("mine", "train", 7)]
    alone = build_mixture_from(spark, recipes.checked({"datasets": entries[:1]}))
    assert alone.count() == 5
    with pytest.raises(ValueError):
        build_mixture_from(spark, {"datasets": entries, "only_english": True})
    labelled = spark.createDataFrame([("en", "the dog"), ("fr", "le chien")], "lang string, text string")
    strict = build_mixture_from(spark, {"datasets": entries, "only_english": True}, labelled)
    assert rows(strict.groupBy("config").count()) == [("mine", 7)]


def test_jobs_run_from_the_command_line(spark, tmp_path):
    from corpusmill.__main__ import run

    source, out, recipe = (str(tmp_path / n) for n in ("chats", "out", "recipe.json"))
    chats(spark, 30).write.parquet(source)
    entry = {"name": "a", "path": source, "layout": "plain", "samples": 20}
    Path(recipe).write_text(json.dumps({"datasets": [entry], "test_fraction": 0.2}))
    run(spark, ["training-text", "--recipe", recipe, "--output", out, "--eos", "<e>"])
    back = spark.read.parquet(out)
    assert back.count() == 20 and set(back.columns) == {"id", "text", "split", "config"}
    with pytest.raises(SystemExit):
        run(spark, ["unknown", "--recipe", recipe])


def test_question_job(spark, tmp_path):
    root = str(tmp_path / "raw")
    df = spark.createDataFrame(
        [("q0", "anatomy", ["x", "y"], 1), ("q1", "law", ["x"], 0), ("q2", "anatomy", ["x"], 3)],
        "question string, subject string, choices array<string>, answer int",
    ).coalesce(1).withColumns({"config": F.lit("all"), "split": F.lit("validation")})
    sinks.write_splits(df, root)
    recipe = recipes.checked(
        {"datasets": [{"name": "cais/mmlu", "path": root, "config": "all", "split": "validation", "subset": "mmlu"}]}
    )
    built = build_questions(spark, recipe)
    assert built.columns == ["dataset", "id", "question", "choices", "answer", "context", "config", "split"]
    assert rows(built.select("id", "answer")) == [("mmlu_0", "B"), ("mmlu_2", "D")]
    valid = {r["id"]: (r["correct_idx"], r["valid"]) for r in prompts(built, "id").collect()}
    assert valid == {"mmlu_0": (1, True), "mmlu_2": (3, False)}


@pytest.mark.parametrize("exact", [True, False])
def test_training_text_job(spark, exact):
    built = build_training_text(chats(spark, 400), ["id"], "<e>", 300, 0.1, 7, exact)
    assert built.count() == 300
    n_test = built.where("split = 'test'").count()
    assert n_test == 30 if exact else 10 < n_test < 60
    assert built.where("text not like 'q%<e>'").count() == 0


def test_every_entry_is_sampled(spark, tmp_path):
    paths = [str(tmp_path / f"t{i}") for i in range(2)]
    for i, path in enumerate(paths):
        chats(spark, 50, start=100 * i).write.parquet(path)
    recipe = {
        "datasets": [
            {"name": "a", "path": paths[0], "layout": "plain", "samples": 20},
            {"name": "b", "path": paths[1], "layout": "plain"},
        ]
    }
    built = build_training_text_from(spark, recipes.checked(recipe), ["id"], "<e>")
    assert rows(built.groupBy("config").count()) == [("a", 20), ("b", 50)]


def test_json_chat_job(spark, tmp_path):
    from corpusmill.__main__ import run

    data = [{"course_id": str(i), "question_id": i, "question_body": f"q{i}", "question_answer": "a"} for i in range(5)]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.json").write_text(json.dumps(data))
    recipe = tmp_path / "r.json"
    recipe.write_text(json.dumps({"datasets": [{"name": "school", "path": str(tmp_path / "raw")}]}))
    run(spark, ["json-chat", "--recipe", str(recipe), "--output", str(tmp_path / "out")])
    back = spark.read.parquet(str(tmp_path / "out"))
    assert rows(back.select("id", "config")) == [(f"school_{i}_{i}", "school") for i in range(5)]


def test_evaluate_job(spark, tmp_path):
    from corpusmill.__main__ import run

    items, texts = str(tmp_path / "items"), str(tmp_path / "texts")
    spark.createDataFrame(
        [(1, "d", 0, "a", ["b", "c"]), (2, "d", 1, "a", ["b", "c"])],
        "item long, dataset string, target int, prompt string, options array<string>",
    ).write.parquet(items)
    spark.createDataFrame([("a b a b",)], "text string").write.parquet(texts)
    recipe = tmp_path / "r.json"
    entry = {"name": "items", "path": items, "layout": "plain"}
    recipe.write_text(json.dumps({"datasets": [entry], "train_text": texts}))
    run(spark, ["evaluate", "--recipe", str(recipe), "--output", str(tmp_path / "out")])
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [("accuracy", 0.5), ("accuracy_d", 0.5)]


def test_stream_sample_job(spark, tmp_path):
    from corpusmill.__main__ import run

    source = str(tmp_path / "in")
    spark.range(2000).select("id").write.parquet(source)
    recipe = tmp_path / "r.json"
    given = {"datasets": [{"name": "s", "path": source}], "percent": 10, "checkpoint": str(tmp_path / "progress")}
    recipe.write_text(json.dumps(given))
    sampled = run(spark, ["stream-sample", "--recipe", str(recipe), "--output", str(tmp_path / "out")])
    assert 100 < sampled.count() < 300


def test_question_set_job(spark, tmp_path):
    from corpusmill.__main__ import run

    root = str(tmp_path / "raw")
    df = spark.createDataFrame(
        [(f"q{i}", "anatomy", ["x", "y"], i % 2) for i in range(30)],
        "question string, subject string, choices array<string>, answer int",
    ).coalesce(1)
    for split in ("validation", "test"):
        path = f"{root}/{split}"
        sinks.write_splits(df.withColumns({"config": F.lit("all"), "split": F.lit(split)}), path)
    entry = {"name": "cais/mmlu", "config": "all"}
    given = {
        "batch_size": 8,
        "datasets": [
            entry | {"path": f"{root}/test", "split": "test", "subset": "a"},
            entry | {"path": f"{root}/test", "split": "test", "subset": "b"},
            entry | {"path": f"{root}/validation", "split": "validation", "subset": "c", "use": "validation"},
        ],
    }
    recipe = tmp_path / "r.json"
    recipe.write_text(json.dumps(given))
    run(spark, ["question-sets", "--recipe", str(recipe), "--output", str(tmp_path / "out")])
    back = spark.read.parquet(str(tmp_path / "out"))
    sizes = back.groupBy("set").agg(F.sum(F.size("prompt")).alias("n"), F.count("*").alias("batches"))
    assert rows(sizes) == [("train", 60, 8), ("validation", 30, 4)]


def test_weights_of_a_recipe(spark, tmp_path):
    path = str(tmp_path / "t")
    chats(spark, 200).write.parquet(path)
    entries = [
        {"name": "a", "path": path, "layout": "plain", "weight": 2.0},
        {"name": "b", "path": path, "layout": "plain", "weight": 0.5},
        {"name": "c", "path": path, "layout": "plain"},
    ]
    built = build_corpus(spark, recipes.checked({"datasets": entries}))
    counts = {r["config"]: r["count"] for r in built.groupBy("config").count().collect()}
    assert counts["a"] == 400 and 70 < counts["b"] < 130 and counts["c"] == 200
