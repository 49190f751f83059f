"""Packing without cuts, drawn orders, greedy chunks, JSON arrays in parts, releases."""

import hashlib
import json
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators import chunking, mixture, packing, sampling
from corpusmill.operators.ordering import position_in_group
from corpusmill.session import staging_path
from corpusmill.sources import releases
from corpusmill.sources.json_arrays import scan_json_array_in_parts


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- packing -------------------------------------------------------------------------------------


def _one_by_one(items, length):
    room, placed = [], []
    for size in items:
        fitting = [(r, i) for i, r in enumerate(room) if r >= size]
        if not fitting:
            room.append(length)
        at = min(fitting)[1] if fitting else len(room) - 1
        placed.append((size, at, length - room[at]))
        room[at] -= size
    return placed, len(room)


@pytest.mark.parametrize("length", [1, 2, 7, 30, 100])
def test_best_fit_is_that_of_examples_one_by_one(length):
    draw = random.Random(length)
    for _ in range(60):
        items = sorted((draw.randint(1, length) for _ in range(draw.randrange(150))), reverse=True)
        histogram = Counter(items)
        shares, blocks = packing.best_fit(histogram, length)
        got = []
        for size in sorted(histogram, reverse=True):
            mine = [s for s in shares if s.size == size]
            for place in range(histogram[size]):
                share = [s for s in mine if s.begin <= place][-1]
                past = place - share.begin
                got.append((size, share.block + past // share.each, share.used + past % share.each * size))
        assert (got, blocks) == _one_by_one(items, length)


def test_best_fit_depends_on_the_lengths_only():
    few, _ = packing.best_fit({n: 3 + n % 5 for n in range(1, 513)}, 512)
    many, blocks = packing.best_fit({n: 10**9 + n for n in range(1, 513)}, 512)
    assert len(many) < 4 * 512 and len(few) < 8 * 512
    assert sum(n * (10**9 + n) for n in range(1, 513)) / (512 * blocks) > 0.99
    with pytest.raises(ValueError):
        packing.best_fit({11: 1}, 10)


def test_no_example_is_cut(spark):
    draw = random.Random(3)
    data = [(i, None if i == 5 else [i] * draw.choice([0, 1, 2, 3, 9, 9, 9, 30])) for i in range(300)]
    df = spark.createDataFrame(data, "position long, ids array<long>").withColumn("size", F.lit("x"))
    blocks = {r["block"]: r["input_ids"] for r in packing.pack_whole(df, "position", "ids", 10).collect()}
    assert set(blocks) == set(range(len(blocks))) and all(len(b) <= 10 for b in blocks.values())
    found = []
    for ids in blocks.values():
        assert ids[-1] == packing.EOS
        found += ids
    want = [x for _, ids in data for x in [*(ids or [])[:9], packing.EOS]]
    assert sorted(found) == sorted(want)
    plan = packing.whole_plan(df.withColumn("n", F.size("ids")), "position", "n", 10)
    used = Counter()
    for r in plan.collect():
        assert r["start"] + r["size"] <= 10
        used.update((r["block"], r["start"] + k) for k in range(r["size"]))
    assert max(used.values()) == 1 and plan.count() == 300
    padded = packing.pack_whole(df, "position", "ids", 10, padded=True)
    assert {len(r["input_ids"]) for r in padded.collect()} == {10}
    assert packing.pack_whole(df.limit(0), "position", "ids", 10).collect() == []


@pytest.mark.parametrize("shard_rows", [1, 7, 1000])
def test_position_in_group(spark, shard_rows):
    draw = random.Random(1)
    data = [(i, draw.choice(["a", "a", "a", "b", None])) for i in range(200)]
    df = spark.createDataFrame(data, "position long, g string").repartition(5)
    seen, want = Counter(), []
    for i, g in data:
        want.append((i, g, seen[g]))
        seen[g] += 1
    assert rows(position_in_group(df, "position", "g", "place", shard_rows)) == sorted(want)


# --- drawn orders --------------------------------------------------------------------------------


def _draw(seed, key):
    return int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:8], 16)


def _interleaved(data, probabilities, seed, stop):
    held = {s: [i for i, x in data if x == s] for s in probabilities}
    drawn = {s: p for s, p in probabilities.items() if p > 0 and held[s]}
    at, through, out = Counter(), set(), []
    while drawn and not (through and stop == "first") and through != set(drawn):
        x, reached = _draw(seed, len(out)), 0.0
        for source, p in drawn.items():
            reached += p
            if x < int(reached / sum(drawn.values()) * 2**32):
                break
        out.append((held[source][at[source] % len(held[source])], source, len(out)))
        at[source] += 1
        if at[source] == len(held[source]):
            through.add(source)
    return sorted(out)


@pytest.mark.parametrize("stop", ["first", "all"])
@pytest.mark.parametrize("probabilities", [
    {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 8, "none": 3, "c": 0}, {"tiny": 0.9, "a": 0.1}, {"b": 1.0},
])
def test_interleaving_is_that_of_one_place_after_the_other(spark, stop, probabilities):
    draw = random.Random(2)
    data = [(i, draw.choice(["a", "b", "b", "c", None, "other"])) for i in range(120)] + [(120, "tiny")]
    df = spark.createDataFrame(data, "position long, source string").repartition(3)
    got = mixture.interleave(df, "position", probabilities, 9, stop=stop, block_rows=16)
    assert rows(got) == _interleaved(data, probabilities, 9, stop)


def test_interleaving_nothing(spark):
    df = spark.createDataFrame([(0, "a")], "position long, source string")
    assert mixture.interleave(df, "position", {"b": 1.0}, 1).collect() == []
    assert mixture.interleave(df.limit(0), "position", {"a": 1.0}, 1).collect() == []
    with pytest.raises(ValueError):
        mixture.interleave(df, "position", {"a": 1.0}, 1, stop="never")


def test_every_epoch_is_another_permutation(spark, plan_of):
    orders = set()
    for n in [*range(1, 20), 97, 1000]:
        for epoch in range(2):
            placed = spark.range(n).select(sampling.epoch_place(F.col("id"), n, epoch).alias("place"))
            order = tuple(r["place"] for r in placed.collect())
            assert sorted(order) == list(range(n))
            orders.add(order)
    assert len(orders) >= 2 * 21 - 8
    # neighbours end up far from each other
    assert sum(abs(a - b) for a, b in zip(order, order[1:])) / 999 > 250
    assert "Exchange" not in plan_of(sampling.epochs(spark.range(50), "id", 50, 3))
    assert sampling.epochs(spark.range(50), "id", 50, 3).groupBy("epoch").count().count() == 3


# --- chunks --------------------------------------------------------------------------------------


def test_greedy_chunks_are_those_of_one_piece_after_the_other(spark, monkeypatch, plan_of):
    monkeypatch.setattr(chunking, "MANY", 3)
    draw = random.Random(4)
    texts = [None, "", "x" * 95, "\n\n".join("w" * draw.randint(0, 25) for _ in range(60))]
    texts += ["".join(draw.choice(["a", "bc ", "\n", "\n\n", "\n## ", "```\n", "😀"]) for _ in range(200)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("chunk", F.lit(1))
    cut = {r[0]: r[1] for r in df.select("id", chunking.pieces(F.col("text"), 20)).collect()}
    want = []
    for i, parts in cut.items():
        made = []
        for part in parts:
            if made and len(made[-1]) + len(part) <= 20:
                made[-1] += part
            else:
                made.append(part)
        assert "".join(made) == (texts[i] or "")
        want += [(i, k, c) for k, c in enumerate(made)]
    got = chunking.chunk_greedily(df, ["id"], "text", 20)
    assert rows(got) == sorted(want)
    assert got.count() < chunking.chunk_documents(df, ["id"], "text", 20).count()
    assert "Exchange" not in plan_of(got)


# --- JSON arrays ---------------------------------------------------------------------------------


def test_json_arrays_in_parts_are_those_read_whole(spark, tmp_path):
    draw = random.Random(1)

    def text():
        return "".join(draw.choice('a{}[]",\\\n\té:😀 ') for _ in range(draw.randrange(12)))

    data = [
        {"id": i, "t": text(), "n": {"x": text(), "l": [{"y": text()} for _ in range(draw.randrange(3))]},
         "file": [text() for _ in range(draw.randrange(3))]}
        for i in range(2000)
    ]
    (tmp_path / "a.json").write_text(json.dumps(data, ensure_ascii=False))
    (tmp_path / "b.json").write_text(json.dumps(data[:7], indent=2))
    (tmp_path / "c.json").write_text(" [ ] \n")
    (tmp_path / "d.json").write_text(json.dumps([{}, {"id": None}, {"id": 3, "more": {"a": [{}]}}]))
    schema = T.StructType.fromDDL("id int, t string, n struct<x string, l array<struct<y string>>>, file array<string>")
    settings = {"spark.sql.files.maxPartitionBytes": "4000", "spark.sql.files.openCostInBytes": "500"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 8
        got = scan_json_array_in_parts(spark, str(tmp_path), schema)
        whole = spark.read.schema(schema).option("multiLine", True).json(str(tmp_path))
        assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# --- releases ------------------------------------------------------------------------------------


def _files(path, run):
    return {str(f): f.stat().st_mtime_ns for f in Path(path.removeprefix("file:")).glob(f"runs/run={run}/**/*.parquet")}


def test_one_config_is_published_again(spark, monkeypatch):
    path = staging_path(spark, "releases-test")
    first = spark.createDataFrame([(1, "a", "train"), (2, "b", "train"), (3, "b", "test")], "x int, config string, split string")
    with pytest.raises(ValueError):
        releases.scan_release(spark, path)
    assert releases.publish(first, path) == 1
    _, listed = releases.release(spark, path)
    held = _files(path, listed["a"])

    again = spark.createDataFrame([(9, "b", "train"), (8, "c/d", "train")], "x int, config string, split string")
    with monkeypatch.context() as broken:  # the driver is lost before the release
        broken.setattr(releases, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            releases.publish(again, path)
    assert rows(releases.scan_release(spark, path, split=None).select("x")) == [(1,), (2,), (3,)]

    assert releases.publish(again, path) == 2
    assert rows(releases.scan_release(spark, path, split=None).select("x")) == [(1,), (8,), (9,)]
    assert rows(releases.scan_release(spark, path, "b", None).select("x", "config")) == [(9, "b")]
    assert rows(releases.scan_release(spark, path, "b", None, number=1).select("x")) == [(2,), (3,)]
    assert rows(releases.scan_release(spark, path, "gone", None)) == []
    assert _files(path, listed["a"]) == held

    with monkeypatch.context() as late:  # another writer took the number
        late.setattr(releases, "release", lambda *a: (1, listed))
        with pytest.raises(releases.ReleaseConflict):
            releases.publish(again, path)
    with pytest.raises(ValueError):
        releases.publish(spark.createDataFrame([(1, None, "train")], "x int, config string, split string"), path)
    assert releases.release(spark, path)[0] == 2
    assert len(releases.vacuum(spark, path)) == 3  # interrupted, in conflict, without a config
    assert rows(releases.scan_release(spark, path, split=None).select("x")) == [(1,), (8,), (9,)]
