"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text stands for each language. A text is parsed from left to right
into the longest pieces that the automaton contains; the language that needs the fewest pieces for
each character, scaled by the size of its training text, wins. A longer text that needs about as many
pieces as the language's own letters in random order is not recognised: nothing in its order speaks
for that language.

Texts are parsed in pieces of ``LANE`` characters, all pieces of a batch in step, so a very long
text needs no more memory and no longer task than many short ones.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import table, unused

UNKNOWN = "und"
SEED = 1
#: The automata are fitted on a bounded sample of the labelled rows: so many documents for each
#: language, in hash order, and so many characters of each from a seeded place on.
SAMPLE_DOCS = 150
SAMPLE_CHARS = 200
ALPHABET = 60  # most frequent letters of the sample; all others share one symbol
MODEL_BYTES = 128 << 20  # of all automata; with many languages, each learns from fewer characters
ASSURED = 128  # letters and blanks; fewer say too little to reject a text
LEARNED = 1024  # of a language's sample; one learned from fewer rejects nothing
RANDOM = 0.85  # of the bits of random order; a text that takes so many is not recognised
LANE = 512
LANES = 2048

BLANK, OTHER, FIRST = 0, 1, 2  # symbols: anything but a letter, a rare letter, the first letter


@dataclass
class Model:
    """``moves[state + symbol]`` holds the next state in the upper bits and the pieces that end in
    the lowest two. A state is a multiple of ``width``."""

    languages: list[str]
    roots: np.ndarray
    moves: np.ndarray
    bits: np.ndarray  # log2 of the training characters
    symbols: dict[str, int]
    width: int
    chance: np.ndarray  # bits that a symbol takes where the training text is in random order


class _Symbols:
    """Text to symbols: lower case, letters by table, runs of anything else as one blank."""

    def __init__(self, symbols: dict[str, int]):
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.table = np.where(self.letter, OTHER, BLANK).astype(np.int32)
        for char, symbol in symbols.items():
            self.table[ord(char)] = symbol

    def __call__(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        found = self.table[points]
        blank = found == BLANK
        if blank.all():
            return found[:0]
        blank[1:] &= blank[:-1].copy()
        blank[0] = found[0] == BLANK
        return found[~blank]


def _automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence of symbols; state 0 is the root."""
    moves, link, length, last = [{}], [-1], [0], 0
    for symbol in text.tolist():
        state = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        back = last
        while back >= 0 and symbol not in moves[back]:
            moves[back][symbol] = state
            back = link[back]
        if back >= 0:
            there = moves[back][symbol]
            if length[there] == length[back] + 1:
                link[state] = there
            else:
                twin = len(moves)
                moves.append(dict(moves[there]))
                length.append(length[back] + 1)
                link.append(link[there])
                while back >= 0 and moves[back].get(symbol) == there:
                    moves[back][symbol] = twin
                    back = link[back]
                link[there] = link[state] = twin
        last = state
    return moves


def _table(moves: list[dict[int, int]], width: int, offset: int) -> np.ndarray:
    """One automaton as rows of moves that never fail: without a transition, the piece ends and the
    next starts with the symbol. The last symbol, padding, only ends a piece."""
    states = len(moves)
    to = np.zeros((states, width), np.int64)
    for state, row in enumerate(moves):
        to[state, list(row)] = list(row.values())
    fails = to == 0
    cost = np.where(fails, 1, 0)
    cost[0] = 0
    again = np.broadcast_to(to[0], to.shape)
    cost += fails & (again == 0)  # a symbol that the language lacks is a piece of its own
    to = np.where(fails, again, to)
    to[:, -1] = 0
    cost[:, -1] = 1
    cost[0, -1] = 0
    return (((to + offset) * width) << 2 | cost).astype(np.int32).ravel()


def fit(samples: dict[str, list[str]], alphabet: int = ALPHABET) -> Model:
    """Automata of the sample texts of each language, in the order of the languages' names."""
    count = Counter(c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha())
    common = sorted(count, key=lambda c: (-count[c], c))[:alphabet]
    symbols = {c: FIRST + i for i, c in enumerate(sorted(common))}
    width = FIRST + len(symbols) + 1
    each = MODEL_BYTES // max(1, 2 * width * 4 * len(samples))
    to_symbols = _Symbols(symbols)
    languages, roots, tables, bits, learned, states = [], [], [], [], [], 0
    for language in sorted(samples):
        parts = [to_symbols(t) for t in samples[language]]
        text = np.concatenate([x for p in parts for x in (p, [BLANK])] or [[]])[:each].astype(np.int64)
        if not (text != BLANK).any():
            continue
        moves = _automaton(text)
        languages.append(language)
        roots.append(states * width << 2)
        tables.append(_table(moves, width, states))
        bits.append(max(1.0, np.log2(len(text))))
        learned.append(text)
        states += len(moves)
    model = Model(
        languages,
        np.array(roots, np.int32),
        np.concatenate(tables) if tables else np.zeros(0, np.int32),
        np.array(bits),
        symbols,
        width,
        np.zeros(len(languages)),
    )
    shuffled = [np.random.default_rng(SEED).permutation(text) for text in learned]
    sizes = np.array([len(text) for text in learned], np.int64)
    chance = np.diagonal(pieces(model, shuffled)) * model.bits / sizes
    model.chance = np.where(sizes < LEARNED, np.inf, chance)
    return model


def pieces(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Number of pieces of each text (rows) in each language (columns)."""
    pad = model.width - 1
    lanes = [max(1, -(-len(t) // LANE)) for t in texts]
    owner = np.repeat(np.arange(len(texts)), lanes)
    out = np.zeros((len(texts), len(model.languages)), np.int64)
    if not len(texts) or not model.languages:
        return out
    padded = np.full(len(owner) * LANE, pad, np.int32)
    at = 0
    for text, n in zip(texts, lanes):
        padded[at : at + len(text)] = text
        at += n * LANE
    padded = padded.reshape(-1, LANE)
    for start in range(0, len(owner), LANES):
        steps = np.ascontiguousarray(padded[start : start + LANES].T)
        now = np.repeat(model.roots[:, None], steps.shape[1], axis=1)
        ended = np.zeros(now.shape, np.int32)
        for step in steps:
            now >>= 2
            now += step
            now = model.moves.take(now)
            ended += now & 3
        ended += (now >> 2 << 2) != model.roots[:, None]
        np.add.at(out, owner[start : start + LANES], ended.T)
    return out


def judge(model: Model, texts: pd.Series, to_symbols: _Symbols) -> pd.DataFrame:
    """Language and score of each text and whether it is recognised as of that language, parsed in
    groups of about ``LANES`` lanes."""
    label, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    recognised = np.zeros(len(texts), bool)
    group, lanes = [], 0

    def flush():
        nonlocal group, lanes
        if group:
            found = pieces(model, [x for _, x in group])
            rate = found * model.bits / np.array([[len(x)] for _, x in group])
            best = rate.argmin(axis=1)
            least = rate.min(axis=1)
            rate[np.arange(len(group)), best] = np.inf
            second = rate.min(axis=1)
            for (i, symbols), b, x, y in zip(group, best, least, second):
                recognised[i] = len(symbols) < ASSURED or x < RANDOM * model.chance[b]
                label[i] = model.languages[b]
                score[i] = 1.0 if np.isinf(y) else 1.0 - x / y
        group, lanes = [], 0

    for i, text in enumerate(texts):
        symbols = to_symbols(text) if text is not None and model.languages else np.zeros(0, np.int32)
        if len(symbols):
            group.append((i, symbols))
            lanes += len(symbols) // LANE + 1
            if lanes >= LANES:
                flush()
    flush()
    return pd.DataFrame({"lang_pred": label, "score": score, "recognised": recognised})


def sample(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict:
    """The bounded training sample of ``docs``: for each language at most ``SAMPLE_DOCS`` excerpts.

    Every labelled row takes part in the draw: rows are first thinned by a hash to a few times what
    is needed, by the language's own count, so that no language gathers in one task.
    """
    usable = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"),
        F.col(text).alias("text"),
        F.xxhash64(F.lit("language"), F.col(key)).alias("draw"),
    )
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    rates = F.create_map(
        *[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 4 * SAMPLE_DOCS / r["n"]))]
    )
    if not counts:
        return {}
    unit = F.pmod("draw", F.lit(1 << 30)) / F.lit(float(1 << 30))
    room = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    start = F.pmod(F.hash("draw"), room) + 1
    rows = (
        usable.where(unit < rates[F.col("lang")])
        .select("lang", "draw", F.col("text").substr(start, F.lit(SAMPLE_CHARS)).alias("excerpt"))
        .distinct()
        .collect()
    )
    found: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["draw"], r["excerpt"])):
        texts = found.setdefault(row["lang"], [])
        if len(texts) < SAMPLE_DOCS:
            texts.append(row["excerpt"])
    return found


def learned_rows(key: Column) -> tuple[Column, Column]:
    """(held out, may be learned from), by the checksum of the key; a null key is neither."""
    third = F.crc32(key.cast("string").cast("binary")) % 3
    return F.coalesce(third == 1, F.lit(False)), F.coalesce(third != 1, F.lit(False))


def predictor(spark: SparkSession, model: Model):
    """A column function from text to (lang_pred, score, recognised)."""
    shared = spark.sparkContext.broadcast(vars(model))

    @F.pandas_udf("lang_pred string, score double, recognised boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Model(**shared.value)
        to_symbols = _Symbols(model.symbols)
        for texts in batches:
            yield judge(model, texts, to_symbols)

    return predict


def identify(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``held_out``, ``lang_pred``, ``score`` and ``recognised``, which replace columns of
    these names.

    Learns from the rows of ``docs`` with a language whose doc_id isn't held out. ``lang_pred`` is
    ``und`` with score 0 for a null text, a text without a letter, and where nothing was learned.
    The score is one minus the ratio of the best to the second-best rate; ties go to the language
    that sorts first. Repeated rows get equal answers. ``recognised`` is false where ``lang_pred`` is
    ``und``, and for a text of at least ``ASSURED`` letters and blanks that needs ``RANDOM`` times the
    pieces of random order or more, if its language was learned from at least ``LEARNED``: random letters, or a
    script that no language was learned in.
    """
    held_out, usable = learned_rows(F.col("doc_id"))
    model = fit(sample(docs.where(usable)))
    predict = predictor(docs.sparkSession, model)
    found = unused(docs, "found")
    return (
        docs.withColumn("held_out", held_out)
        .withColumn(found, predict(F.col("text")))
        .withColumns({c: F.col(f"{found}.{c}") for c in ("lang_pred", "score", "recognised")})
        .drop(found)
    )


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")
