"""Hard negatives, clusters and licence scans against brute force, and what they make of odd input."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusmill.llm import licences, lloyd, negatives
from tools.check import compare, database

VECTORS = "vec_id long, embedding array<float>, label int"
DOCS = "doc_id long, text string"


@pytest.mark.parametrize("name", ["op11_negatives", "op12_clusters", "op13_licences"])
def test_query_agrees_with_its_sql(spark, sf_dir, name):
    assert compare(spark, database(sf_dir), name, sf_dir) is None


# --- hard negatives ------------------------------------------------------------------------------


@pytest.mark.parametrize("width, most", [(1, 1), (64, 300), (130, 2000), (64, 1 << 22), (3, 1 << 24)])
def test_products_are_exact(width, most):
    draw = np.random.default_rng(width)
    left, right = (draw.integers(-most, most + 1, (n, width)) for n in (7, 11))
    left[0], right[0], right[1] = most, most, -most
    primes = negatives.moduli(width * most * most)
    got = negatives.products(negatives.residues(left, primes), negatives.residues(right, primes), primes)
    assert (got == left.astype(object) @ right.T.astype(object)).all()


def test_moduli_are_primes_that_float32_can_hold():
    primes = negatives.moduli(1 << negatives.BITS)
    assert all(p % q for p in primes for q in range(2, p)) and math.prod(primes) > 2 << negatives.BITS
    assert math.prod(primes) < 1 << 63
    assert negatives.SLAB * (primes[0] // 2) ** 2 < 1 << 24


def _mined(rows, every, positives, count, window):
    taken = sorted({(i, l, tuple(v)) for i, l, v in rows if i % every == 0})
    anchors = {}
    for i, l, v in taken:
        anchors.setdefault(i, (l, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(v, w)), i, l == label) for i, l, w in rows if i != a]
        near = sorted((s, i) for s, i, same in scored if same)[:positives]
        for s, i in near:
            low, high = window[0] * -s, window[1] * -s
            hard = sorted((t, j) for t, j, same in scored if not same and low <= 100 * -t <= high)[:count]
            out += [(a, i, r + 1, j, -s, -t) for r, (t, j) in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("seed, span", [(1, 3), (2, 400), (3, 1)])
def test_mining_against_brute_force(spark, monkeypatch, seed, span):
    monkeypatch.setattr(negatives, "GROUP", 12)  # several groups and stripes
    monkeypatch.setattr(negatives, "STRIPE", 40)
    monkeypatch.setattr(negatives, "LEAST", 10)
    monkeypatch.setattr(negatives, "TILE", 7)
    draw = random.Random(seed)
    rows = [(i, draw.randrange(3), [draw.randint(-span, 2 * span) for _ in range(draw.choice([5, 5, 9]))]) for i in range(160)]
    rows += [(160, 7, []), (165, 0, []), rows[5], rows[5], (5, 1, [1, 1]), rows[8], (170, 9, [10**6] * 9)]
    frame = spark.createDataFrame(rows, "id long, label long, impacts array<long>")
    frame = frame.withColumns({c: F.lit(1) for c in ("cell", "kind", "slot", "score", "low", "rank")})
    got = negatives.mine(frame, every=5).collect()
    assert sorted(map(tuple, got)) == _mined(rows, 5, 5, 3, (50, 95))


def test_rows_that_take_no_part_and_labels_with_noise(spark):
    rows = [(7, [0.5, -0.25], 9), (8, [1.0], 2), (None, [1.0], 1), (9, None, 1), (10, [1.0], None),
            (11, [1.0, None], 1), (12, [float("nan")], 1), (13, [float("inf")], 1), (14, [], 3)]
    got = negatives.usable(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted(map(tuple, got)) == [(7, 0, [128, -64]), (8, 2, [256]), (14, 4, [])]
    assert negatives.mine(negatives.usable(spark.createDataFrame([], VECTORS))).collect() == []
    alone = spark.createDataFrame([(50, [1.0], 1)], VECTORS)
    assert negatives.mine(negatives.usable(alone)).collect() == []
    with pytest.raises(ValueError):
        negatives.mine(negatives.usable(spark.createDataFrame([(50, [1e9], 1)], VECTORS)))


# --- clusters ------------------------------------------------------------------------------------


def _clustered(rows, k, rounds, seed="1"):
    def first(row):
        return hashlib.sha256(f"{seed}:{'' if row[0] is None else row[0]}".encode()).hexdigest(), row[1]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(centres))

    centres = [v for _, v in sorted(map(first, rows))[:k]]
    for _ in range(rounds):
        held = defaultdict(list)
        for _, v in rows:
            held[nearest(v)[1]].append(v)
        for n, vs in held.items():
            centres[n] = [sum(column) // len(vs) for column in zip(*vs)]
    placed = [(i, *nearest(v)[::-1]) for i, v in rows]
    of = defaultdict(int)
    for _, n, d in placed:
        of[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, n, d, of[n], sum(of.values()), digest[n]) for i, n, d in placed), key=str)


@pytest.mark.parametrize("seed, width, k, span", [(1, 7, 5, 100), (2, 5, 16, 1), (3, 1, 3, 10**6)])
def test_clusters_against_brute_force(spark, monkeypatch, seed, width, k, span):
    monkeypatch.setattr(lloyd, "BLOCK", 3)
    monkeypatch.setattr(lloyd, "CHUNK", 9)
    draw = random.Random(seed)
    rows = [(i, [draw.randint(-span, span) for _ in range(width)]) for i in range(120)]
    rows += [rows[3], rows[3], (3, [0] * width), (None, [1] * width), (None, [-1] * width)]
    frame = spark.createDataFrame(rows, "vec_id long, cells array<long>").repartition(4)
    frame = frame.withColumns({c: F.lit(1) for c in ("cluster", "distance", "chunk", "block", "n", "ids")})
    got = lloyd.cluster(frame, width, k, rounds=3).collect()
    assert sorted(map(tuple, got), key=str) == _clustered(rows, k, 3)


def test_vectors_that_are_not_kept_and_few_rows(spark):
    wide = [0.5] * 64
    rows = [(1, wide, 1), (None, wide, None), (2, wide[1:], 1), (3, None, 1), (4, wide[1:] + [None], 1),
            (5, wide[1:] + [float("nan")], 1), (6, wide[1:] + [float("-inf")], 1)]
    got = lloyd.cluster(lloyd.usable(spark.createDataFrame(rows, VECTORS))).collect()
    assert sorted(((r[0], *r[1:5]) for r in got), key=str) == [(1, 0, 0, 0, 0), (None, 0, 0, 0, 0)]
    assert lloyd.cluster(lloyd.usable(spark.createDataFrame([], VECTORS))).collect() == []
    far = spark.createDataFrame([(1, [1e9] * 64, 1)], VECTORS)
    with pytest.raises(ValueError):
        lloyd.cluster(lloyd.usable(far))


# --- licences ------------------------------------------------------------------------------------


def _words(text):
    lowered = (text or "").translate(str.maketrans(licences.UPPER, licences.LOWER))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def _scanned(text, templates, block, threshold=0.8):
    words = _words(text)
    places = [(i, label) for phrase, label in licences.PHRASES.items() for i in range(len(words))
              if words[i : i + len(phrase.split())] == phrase.split()]
    best = {}
    for label, template in templates:
        wanted = set(_words(template))
        starts = range(0, max(len(words) - block // 2, 1), block // 2)
        most = max((len(wanted & set(words[s : s + block])) for s in starts), default=0)
        if wanted and most >= math.ceil(threshold * len(wanted) - 1e-9):
            best[label] = max(best.get(label, 0), most / len(wanted))
    base = {label for _, label in places}
    starts = [i for i, _ in places]
    score = 1.0 if places else max(best.values(), default=0.0)
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(base | best.keys())), score)


ODD_TEXTS = [
    None, "", " \n.", "MIT License", "mit license MIT-LICENSE,mit\nlicense", "cc by cc by-nc cc by",
    "the GNU General Public Licenses", "GNU  General\tPublic (License) apacheé license apache license",
    "É MIT license　MIT license", "x" * 200_000, "word " * 5000 + "apache license" + " word" * 5000,
    "Permission is granted, free of charge, to any person obtaining a copy of the software hereby",
    "// Redistribution and use in source\n// and binary forms with or without\n// modification permitted",
    "nul\x00mit\x7flicense", "mitlicense", "mit", "license mit", "gnu general public",
]


def test_scan_against_brute_force(spark):
    draw = random.Random(5)
    vocabulary = [w for _, t in licences.TEMPLATES for w in _words(t)]
    texts = list(ODD_TEXTS)
    for _ in range(60):  # parts of templates between other words, near the threshold
        made = []
        for _ in range(draw.randrange(1, 5)):
            kept = [w for w in _words(draw.choice(licences.TEMPLATES)[1]) if draw.random() < 0.85]
            draw.shuffle(kept)
            made += [draw.choice(["so", "then", draw.choice(vocabulary)]) for _ in range(draw.randrange(60))] + kept
        texts.append(" ".join(made))
    texts += [texts[-1]] * 40
    frame = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], DOCS)
    frame = frame.withColumns({c: F.lit("x") for c in ("labels", "score", "_a", "_words", "block", "template", "n_words")})
    got = sorted((tuple(r) for r in licences.scan(frame).collect()), key=str)
    want = [(i if i % 7 else None, *_scanned(t, licences.TEMPLATES, licences.BLOCK)) for i, t in enumerate(texts)]
    assert got == sorted(want, key=str)
    assert any(w[5] and not w[4] for w in want) and any("," in w[5] for w in want)


@pytest.mark.parametrize("threshold", [0.34, 0.5, 1.0])
def test_filters_lose_no_block(spark, threshold):
    draw = random.Random(9)
    templates = [(f"t{i}", " ".join(f"w{draw.randrange(40)}" for _ in range(draw.randrange(1, 12)))) for i in range(12)]
    templates += [("none", "..."), ("t0", templates[1][1])]
    texts = [" ".join(f"w{int(40 * draw.random() ** 2)}" for _ in range(draw.randrange(60))) for _ in range(80)]
    frame = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licences.scan(frame, templates, threshold=threshold, block=16).collect()}
    want = [_scanned(t, templates, 16, threshold) for t in texts]
    assert got == {i: (w[5], w[6]) for i, w in enumerate(want)}


def test_scan_of_nothing_and_without_templates(spark):
    assert licences.scan(spark.createDataFrame([], DOCS)).collect() == []
    frame = spark.createDataFrame([(1, "mit license")], DOCS)
    assert licences.scan(frame, templates=[]).first()["labels"] == "mit"


def test_scan_stays_in_the_jvm(spark, sf_dir, plan_of):
    plan = plan_of(entry.queries()["op13_licences"](spark, sf_dir))
    for worker in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert worker not in plan
