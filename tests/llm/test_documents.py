"""The operators on documents against brute force, and what they make of odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import language, leaks, lines, mixing, near, substring, token_file
from corpusmill.llm.components import components
from corpusmill.llm.fm_index import Index
from corpusmill.llm.simple8b import BLOCK, decode, encode

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Documents from (id, text, lang, source), with columns named like the operators' own."""
    frame = spark.createDataFrame([(i, t, l, s, len(t or "")) for i, t, l, s in rows], SCHEMA)
    extra = {"size": "1", "target": "2", "copies": "3", "class_id": "4", "score": "5", "mark": "6", "row": "7",
             "key": "8", "doc": "9", "held_out": "10", "lang_pred": "11", "_leak": "12", "part": "13"}
    return frame.withColumns({k: F.lit(int(v)) for k, v in extra.items()})


def words_of(seed, n, vocabulary=4000):
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


ODD = [
    (None, None, None, None),
    (None, "", "en", "a"),
    (900, " \n\t ", "en", None),
    (901, None, "fr", "a"),
    (902, "one", None, "b"),
    (902, "one", None, "b"),
    (902, "two words", "en", "b"),
    (903, "x" * 300_000, "en", "c"),
    (None, "nul\x00 and \x1c separators\x85 of all kinds", "en", "c"),
]


def corpus(spark):
    """Copies, near copies, shared passages, and odd rows."""
    rows = []
    for i in range(30):
        rows.append((i, " ".join(words_of(i, 120)), "en", f"s{i % 4}"))
    base = words_of(1000, 200)
    rows += [(100 + i, " ".join(base), "en", "copies") for i in range(8)]
    for i in range(12):
        changed = list(base)
        changed[10 + 12 * i] = "other"
        rows.append((120 + i, " ".join(changed), "en", "near"))
    passage = words_of(2000, 70)
    for i in range(15):
        rows.append((200 + i, " ".join(words_of(3000 + i, 40) + passage + words_of(4000 + i, 30)), "en", "s0"))
    return rows + ODD


def split(text):
    return (text or "").encode("utf-8", "surrogatepass").split()


# --- line templates ------------------------------------------------------------------------------


def test_recurring_templates_are_dropped_and_other_lines_stay(spark):
    rows = [(i, f"user {i} logged in from host {i % 3} today at noon\nown line {i} {'abcdefghijkl'[i]} here", "en", "a") for i in range(12)]
    rows += [(50, "user 7 logged in\n\nplain", "en", "a"), (51, None, "en", "a"), (52, "", "en", "a")]
    got = {r["doc_id"]: r for r in lines.without_recurring(documents(spark, rows)).collect()}
    for i in range(12):
        assert (got[i]["n_lines"], got[i]["n_dropped"]) == (2, 1)
        assert got[i]["text"] == rows[i][1].split("\n")[1]
    assert (got[50]["n_dropped"], got[50]["text"]) == (0, rows[12][1])
    assert (got[51]["n_lines"], got[51]["text"]) == (0, None) and got[52]["n_lines"] == 1


FIRST = "Anna Bert Cleo Dora Emil Finn Greta Hugo Ida Jan Kai Lea".split()


def generalised(texts):
    """Plain reading of the tree: (document, place of line) of the lines that go."""
    leaves = defaultdict(list)
    for doc, text in enumerate(texts):
        for pos, line in enumerate(text.split("\n")):
            masked = tuple("<*>" if any(c.isdigit() for c in t) else t for t in line.split())
            leaves[len(masked), masked[:3]].append((doc, pos, masked))
    gone = set()
    for (size, head), members in leaves.items():
        if not size or len({d for d, _, _ in members}) < 10:
            continue
        pairs = {(d, m) for d, _, m in members}
        support = Counter((p, t) for _, m in pairs for p, t in enumerate(m) if p >= 3 and t != "<*>")
        lead, holders, made = sum(t != "<*>" for t in head), defaultdict(set), {}
        for d, pos, m in members:
            fixed = [(p, t) for p, t in enumerate(m) if support[p, t] >= 10]
            firm = [x for x in fixed if 2 * support[x] >= len(pairs)]
            keys = [("close", *fixed)] if lead + len(fixed) >= 0.8 * size else []
            if firm and lead + len(firm) >= 4 and 2 * (lead + len(firm) + m.count("<*>")) >= size:
                keys.append(("wide", *firm))
            made[d, pos] = keys or [m]
            for key in made[d, pos]:
                holders[key].add(d)
        gone |= {at for at, keys in made.items() if any(len(holders[k]) >= 10 for k in keys)}
    return gone


def test_templates_with_several_fields_against_a_plain_reading(spark):
    draw = random.Random(11)
    makers = [
        lambda i: f"Logged in as {FIRST[i % 12]} {FIRST[(i * 5) % 12]}x from {FIRST[(i * 7) % 12]}town",
        lambda i: f"Last updated 2024-0{i % 9}-11 by {FIRST[i % 12]} {FIRST[(i * 7) % 12]} at 1{i % 9}:00",
        lambda i: f"a line of {draw.choice(FIRST)} {draw.choice(FIRST)} {draw.choice(FIRST)} own",
        lambda i: f"one of the {draw.choice(FIRST)} {draw.choice(FIRST)} {draw.choice(FIRST)} {draw.choice(FIRST)} stays",
        lambda i: " ".join(draw.choice("the a of to in".split()) for _ in range(draw.randint(1, 9))),
    ]
    for count in (9, 10, 60):
        texts = ["\n".join(make(i) for make in makers) for i in range(count)]
        rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
        got = {r["doc_id"]: r for r in lines.without_recurring(documents(spark, rows)).collect()}
        gone = generalised(texts)
        for i, text in enumerate(texts):
            kept = [line for pos, line in enumerate(text.split("\n")) if (i, pos) not in gone]
            assert got[i]["text"] == "\n".join(kept)
        logins = sum((i, 0) in gone and (i, 1) in gone for i in range(count))
        assert logins == (0 if count == 9 else count)


def test_line_templates_of_odd_rows_and_of_nothing(spark):
    got = lines.without_recurring(documents(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r["n_dropped"] == 0 for r in got)
    assert lines.without_recurring(documents(spark, [])).count() == 0


def test_line_templates_run_without_python(spark, plan_of):
    plan = plan_of(lines.without_recurring(documents(spark, [(1, "a b c", "en", "a")])))
    assert "Python" not in plan and "Pandas" not in plan


# --- mixing --------------------------------------------------------------------------------------


def test_targets_follow_the_weights_and_stop_at_the_limit(spark):
    sizes = {"a": 1000, "b": 10, "c": 5000, "d": 700, None: 90}
    frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
    weights = {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}
    budget, capped = 1.5 * sum(sizes.values()), {}
    while True:  # the excess goes round by round to those below their limit
        level = (budget - sum(capped.values())) / sum(w for s, w in weights.items() if s not in capped)
        above = {s: 2 * sizes[s] for s, w in weights.items() if s not in capped and level * w > 2 * sizes[s]}
        if not above:
            break
        capped |= above
    want = {s: capped.get(s, level * w) for s, w in weights.items()}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(budget)


def test_mixed_copies(spark):
    docs = documents(spark, corpus(spark))
    plan = mixing.with_copies(docs.select("doc_id", "text", "source")).collect()
    assert len(plan) == len(corpus(spark))
    for r in plan:
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert math.floor(rate) <= r["copies"] <= min(2, math.floor(rate) + 1)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in plan)
    assert mixed.where("size <> 1 or copies <> 3").count() == 0
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(documents(spark, [])).count() == 0


def test_rows_without_an_id_are_drawn_by_their_text(spark):
    rows = [(None, f"word {i} " * 5, "en", "abc"[i % 3]) for i in range(600)] + [(None, None, "en", "a")] * 3
    got = mixing.with_copies(documents(spark, rows).select("doc_id", "text", "source")).collect()
    taken, target = {}, {}
    for r in got:
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["copies"]
        target[r["source"]] = r["target"]
    assert len(got) == len(rows)
    assert all(abs(taken[s] - target[s]) < 0.2 * target[s] for s in target)


def test_columns_of_the_same_names_stay(spark):
    frame = documents(spark, [(i, f"some words {i}", "en", "a") for i in range(9)]).select("doc_id", "text", "lang", "source")
    more = frame.withColumns({c: F.lit("mine") for c in ("_source", "n", "_found", "found", "size", "target")})
    mixed = mixing.with_copies(more)
    assert mixed.where("_source = 'mine' and n = 'mine' and found = 'mine' and size = 3").count() == 9
    assert mixing.mix(more).columns == more.columns
    known = language.identify(more)
    assert known.where("_found = 'mine' and found = 'mine' and lang_pred = 'en'").count() == 9


def test_held_out_documents_of_the_tables_are_recognised(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    told = language.identify(docs.select("doc_id", "text", "lang")).where("held_out and lang is not null and lang_pred <> 'und'")
    right, of = told.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert of > 10 and right >= 0.97 * of


# --- passages ------------------------------------------------------------------------------------


def without_passages(rows):
    """By brute force: (id, words, removed, kept) of each row."""
    seen = {}
    for i, text, *_ in rows:
        w = split(text)
        for k in range(len(w) - 49):
            window = tuple(w[k : k + 50])
            seen[window] = min(seen.get(window, math.inf), math.inf if i is None else i)
    out = []
    for i, text, *_ in rows:
        w = split(text)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if seen[tuple(w[k : k + 50])] < (math.inf if i is None else i):
                gone[k : k + 50] = [True] * 50
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return Counter(out)


@pytest.mark.parametrize("hot", [3, 4096])
def test_repeated_passages(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    rows = corpus(spark) + [(None, " ".join(words_of(1000, 200)), "en", "a")]
    got = substring.without_repeats(documents(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == without_passages(rows)


def test_repeated_passages_of_nothing(spark):
    assert substring.without_repeats(documents(spark, [])).count() == 0


def test_index_against_brute_force():
    draw = np.random.default_rng(5)
    for _ in range(60):
        window = int(draw.integers(2, 6))
        sequences = [draw.integers(0, 3, int(draw.integers(window, 14))).astype("u8") for _ in range(4)]
        owners = np.sort(draw.integers(0, 4, 4))
        index = Index(sequences, owners, 20)
        repeated = index.repeated(window, owners)
        held = defaultdict(lambda: math.inf)
        for s, o in zip(sequences, owners):
            for k in range(len(s) - window + 1):
                held[tuple(s[k : k + window])] = min(held[tuple(s[k : k + window])], o)
        for s, o, start in zip(sequences, owners, index.starts):
            for k in range(len(s)):
                want = k + window <= len(s) and held[tuple(s[k : k + window])] < o
                assert repeated[start + k] == want


# --- token files ---------------------------------------------------------------------------------


def test_simple8b_round_trip():
    draw = np.random.default_rng(2)
    for values in (
        draw.integers(0, 50257, 3 * BLOCK + 5),
        draw.integers(0, 2, 700),
        np.zeros(0),
        np.array([2**63, 0, 2**60, 2**60 - 1, 1]),
        np.concatenate([draw.integers(0, 1 << b, 99) for b in range(1, 63)]),
    ):
        values = np.asarray(values).astype("u8")
        found = [(min(BLOCK, len(values) - i * BLOCK), w, e) for i, (w, e) in enumerate(encode(values))]
        assert np.array_equal(decode(found), values)
        for i, block in enumerate(found):  # any block alone
            assert np.array_equal(decode([block]), values[i * BLOCK : (i + 1) * BLOCK])


def test_token_files_hold_the_librarys_ids(spark):
    from tokenizers import Tokenizer

    rows = [(i, t) for i, t, *_ in corpus(spark) if i is not None] + [
        (2000, "a <|endoftext|> b"), (2001, "tabs\tand  runs   of\n\n\nspaces  "), (2002, "it's we'll 'x")]
    got = token_file.tokenised(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    library = Tokenizer.from_file(token_file.tokenizer_path())
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in rows if i != 902}
    order = sorted(r["start"] for r in got)
    assert len(got) == len(rows) and order == list(np.cumsum([0] + [r["n_tokens"] for r in sorted(got, key=lambda r: r["start"])])[:-1])
    for r in sorted(got, key=lambda r: r["start"]):
        if r["doc_id"] != 902:
            assert (r["n_tokens"], r["ids_crc32"]) == (len(ids[r["doc_id"]]), zlib.crc32(ids[r["doc_id"]].tobytes()))
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == sorted(i for i, _ in rows)


def test_token_files_of_odd_rows_and_of_nothing(spark):
    got = token_file.tokenised(documents(spark, ODD)).collect()
    assert len(got) == len(ODD) and sum(r["n_tokens"] == 1 for r in got) == 3
    assert token_file.tokenised(documents(spark, [])).count() == 0


# --- leaks ---------------------------------------------------------------------------------------


def test_leaks_exact_edited_and_none(spark):
    items = [(i, " ".join(words_of(7000 + i, 30)) + ". The answer is " + " ".join(words_of(7100 + i, 4)) + ".") for i in range(12)]
    rows = [(i, " ".join(words_of(i, 150)), "en", "a") for i in range(40)]
    for i in range(12):
        text = items[i][1].upper() if i % 3 == 0 else items[i][1]
        if i % 3 == 1:  # every sixth word is another one
            text = " ".join("other" if k % 6 == 5 else w for k, w in enumerate(text.split()))
        rows.append((100 + i, " ".join(words_of(500 + i, 60)) + " " + text + " " + " ".join(words_of(600 + i, 50)), "en", "a"))
    benchmark = spark.createDataFrame([*items, (50, None), (51, ""), (None, "...")], "item_id long, text string")
    docs = documents(spark, rows + ODD)
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leak_pairs(docs, benchmark).collect()}
    assert got == {(100 + i, i) for i in range(12)}
    kept = leaks.without_leaks(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == 40 + len(ODD)
    assert leaks.without_leaks(documents(spark, []), benchmark).count() == 0
    assert leaks.leak_pairs(docs, benchmark.where("item_id = 50")).count() == 0


def test_leaks_of_long_items_against_brute_force(spark):
    draw = np.random.default_rng(8)

    def text(n):
        return [f"w{k}" for k in np.minimum(draw.zipf(1.3, n), 30_000)]

    lengths = [64, 65, 130, 200, 250, 300, 400, 600, 800, 1000]
    items = [text(n) for n in lengths]
    rows = [(i, " ".join(text(400)), "en", "a") for i in range(60)]
    for i, item in enumerate(items):
        for k, share in enumerate([1.0, 0.85, 0.6, 0.3]):
            kept = [w if draw.random() < share else f"x{draw.integers(30_000)}" for w in item]
            rows.append((100 + 10 * i + k, " ".join(text(150) + kept + text(90)), "en", "a"))
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leak_pairs(documents(spark, rows), benchmark).collect()}

    def numbers(words):
        return np.array([zlib.crc32(w.encode()) for w in words])

    expected = set()
    for i, item in enumerate(items):
        for key, body, *_ in rows:  # the answer of an item without a full stop is the whole item
            if leaks._common_subsequence(numbers(item), numbers(body.split())) >= leaks.COVERED * len(item):
                expected.add((key, i))
    assert {(100 + 10 * i, i) for i in range(len(items))} <= expected and got == expected


def test_longest_common_subsequence():
    draw = random.Random(4)
    for _ in range(50):
        a, b = ([draw.randrange(4) for _ in range(draw.randrange(1, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert leaks._common_subsequence(np.array(a), np.array(b)) == table[-1][-1]


# --- near-duplicates -----------------------------------------------------------------------------


def classes_of(rows):
    """By brute force: the smallest id of each row's component."""
    sets = {}
    for i, text, *_ in rows:
        w = split(text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    name = {i: i for i in sets}
    ids = sorted(sets)
    for _ in ids:
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if both and both / len(sets[a] | sets[b]) >= 0.8:
                    name[a] = name[b] = min(name[a], name[b])
    return name


def test_near_classes_against_brute_force(spark):
    rows = [r for r in corpus(spark) if r[0] is not None and r[0] != 902]
    # a chain: each is near the next one only
    chain = words_of(9000, 100)
    for i in range(6):
        rows.append((300 + i, " ".join([*chain[4 * i :], *words_of(9100, 4 * i)]), "en", "chain"))
    got = {r["doc_id"]: r["class_id"] for r in near.with_class(documents(spark, rows)).collect()}
    assert got == classes_of(rows)


def test_near_classes_of_pairs_with_uneven_repeats(spark):
    rows = []
    for i in range(30):
        base = words_of(20_000 + i, 400, 10**6)
        for k in range(2):  # 396 shared shingles; 44 of each text's own, 40 of them repeat 50 times
            own = words_of(30_000 + 2 * i + k, 40, 10**6)
            rows.append((100 * i + k, " ".join(base + own * 50), "en", "a"))
    got = {r["doc_id"]: r["class_id"] for r in near.with_class(documents(spark, rows)).collect()}
    assert got == {100 * i + k: 100 * i for i in range(30) for k in range(2)}


def test_near_classes_of_a_repeated_id_with_several_texts(spark):
    rows = []
    for i in range(8):
        for k in range(3):  # three texts of one id, and a document that is near each of them
            text = words_of(40_000 + 10 * i + k, 200, 10**6)
            rows.append((100 * i, " ".join(text), "en", "a"))
            rows.append((100 * i + 1 + k, " ".join([*text, "more"]), "en", "a"))
    got = {(r["doc_id"], r["class_id"]) for r in near.with_class(documents(spark, rows)).collect()}
    assert got == {(100 * i + k, 100 * i) for i in range(8) for k in range(4)}


@pytest.mark.parametrize("centres", [0, 3])
def test_near_classes_of_a_group_about_the_similarity(spark, monkeypatch, centres):
    """Copies of which some pairs are similar and some are just not, in parts and stripes."""
    for name, value in {"CENTRES": centres, "PART": 5, "STRIPE": 7, "STEP": 3, "MATCHES": 50}.items():
        monkeypatch.setattr(near, name, value)
    rows, draw = [], random.Random(7)
    for g in range(3):
        base = words_of(60_000 + g, 120, 10**6)
        for i in range(25):
            text = list(base)
            for at in draw.sample(range(120), draw.randrange(6)):
                text[at] = f"new{draw.randrange(10**6)}"
            rows.append((1000 * g + i, " ".join(text), "en", "a"))
    want = classes_of(rows)
    assert 3 < len(set(want.values())) < 75
    got = {r["doc_id"]: r["class_id"] for r in near.with_class(documents(spark, rows)).collect()}
    assert got == want


def test_one_of_each(spark):
    docs = documents(spark, corpus(spark))
    kept = near.one_of_each(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and len([i for i in ids if i and 100 <= i < 140]) == 1
    assert ids.count(902) == 2 and ids.count(None) == 3  # two texts of one id; null ids by their text
    assert kept.where("class_id <> 4 or key <> 8").count() == 0
    assert near.one_of_each(documents(spark, [])).count() == 0


def test_signatures_estimate_the_probability_jaccard():
    a, b = words_of(1, 400), words_of(1, 400)
    b[100:140] = words_of(2, 40)
    signature, found = near.signatures([" ".join(a), " ".join(b), "", "too few"], registers=2048, weighted=False)
    agree = (signature[0] == signature[1]).mean()
    x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
    assert abs(agree - len(x & y) / len(x | y)) < 0.05 and list(found) == [True, True, False, True]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 20)] + [(30, 40), (41, 40), (50, 50)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {**{i: 1 for i in range(1, 21)}, 30: 30, 40: 30, 41: 30}
    assert {r["node"]: r["component"] for r in got} == want


# --- language ------------------------------------------------------------------------------------


def test_cross_parsing_counts_longest_pieces():
    model = language.fit({"x": ["abcabd" * 3], "y": ["dcba" * 5]})
    to_symbols = language._Symbols(model.symbols)
    for text in ("abcabdabc", "dcbadcba", "abdz cab", "zz", "a b c"):
        symbols = to_symbols(text)
        for place, name in enumerate(model.languages):
            sample = np.append(to_symbols({"x": "abcabd" * 3, "y": "dcba" * 5}[name]), language.BLANK).tolist()
            held, pieces, at = {tuple(sample[i:j]) for i in range(len(sample)) for j in range(i, len(sample) + 1)}, 0, 0
            while at < len(symbols):
                end = at + 1
                while end <= len(symbols) and tuple(symbols[at:end].tolist()) in held:
                    end += 1
                at, pieces = max(at + 1, end - 1), pieces + 1
            assert language.pieces(model, [symbols])[0, place] == pieces


def test_languages_are_recognised(spark):
    speech = {"en": "the house and the garden of this old town with many trees ", "de": "das haus und der garten dieser alten stadt mit vielen bäumen "}
    draw = random.Random(3)
    rows = []
    for i in range(240):
        lang = ("en", "de")[i % 2]
        w = speech[lang].split()
        rows.append((i, " ".join(draw.choice(w) for _ in range(40)), lang, "a"))
    docs = documents(spark, rows + ODD)
    got = language.identify(docs.select("doc_id", "text", "lang")).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 240:
            assert r["lang_pred"] == r["lang"]
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in got)
    none = language.identify(documents(spark, [(1, "text", None, "a")]).select("doc_id", "text", "lang"))
    assert [r["lang_pred"] for r in none.collect()] == ["und"]
    assert language.identify(documents(spark, []).select("doc_id", "text", "lang")).count() == 0


def test_texts_in_random_order_are_not_recognised(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    draw = random.Random(4)
    noise = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(400)) for _ in range(5)]
    long = [r["text"] for r in given if r["text"] and len(r["text"]) > 1000][:5]
    noise += ["".join(draw.sample(t, len(t))) for t in long] + ["\u044f\u0437\u044b\u043a \u0438 " * 60, noise[0] * 300]
    short = ["zqxj kwv", "\u044f\u0437\u044b\u043a", "x"]
    empty = [None, "", "12 34 - 56"]
    first = 10**9
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in given]
    rows += [(first + i, t, None) for i, t in enumerate(noise + short + empty)]
    got = {
        r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    }
    letters = re.compile(r"[^\W\d_]")
    wrong = [r["doc_id"] for r in given if got[r["doc_id"]]["recognised"] != bool(letters.search(r["text"] or ""))]
    assert not wrong  # of the given documents, those with a letter stay
    n = len(noise)
    assert [i for i in range(n) if got[first + i]["recognised"]] == []
    assert all(got[first + i]["lang_pred"] != "und" for i in range(n))
    assert all(got[first + n + i]["recognised"] for i in range(len(short)))
    assert not any(got[first + n + len(short) + i]["recognised"] for i in range(len(empty)))


def test_a_language_of_few_letters_rejects_nothing():
    model = language.fit({"x": ["abcabd" * 3], "y": ["dcba" * 5]})
    told = language.judge(model, pd.Series(["qqzz" * 200, None, "7"]), language._Symbols(model.symbols))
    assert told["recognised"].tolist() == [True, False, False]
    nothing = language.judge(language.fit({}), pd.Series(["text", None]), language._Symbols({}))
    assert nothing["recognised"].tolist() == [False, False] and set(nothing["lang_pred"]) == {"und"}


def test_the_language_stage_rejects_what_is_not_recognised(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    noise = docs.limit(3).withColumns(
        {"doc_id": F.col("doc_id") + 10**9, "text": F.lit("qzxv jkwq vxzj " * 40), "lang": F.lit(None).cast("string")}
    )
    kept = corpus_pipeline.language(spark, docs.unionByName(noise), sf_dir)
    assert kept.columns == docs.columns
    want = docs.where(F.col("text").rlike("\\p{L}")).select("doc_id").collect()
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in want)


# --- the pipeline --------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "tokens"]
    sf_dir = "/root/testdata/sf0.001"
    docs = documents(spark, corpus(spark))
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        if name == "language":
            assert out.count() == len(corpus(spark)) - 4  # nulls and blanks go
    sha = hashlib.sha256(b"".join(str(tuple(r)).encode() for r in sorted(corpus_pipeline.run(spark, sf_dir).collect()))).hexdigest()
    assert sha == hashlib.sha256(b"".join(str(tuple(r)).encode() for r in sorted(corpus_pipeline.run(spark, sf_dir).collect()))).hexdigest()
