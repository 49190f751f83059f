"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into overlapping passages. Their TF-IDF vectors over the terms of the benchmark
are reduced by a randomised eigendecomposition of the term matrix, whose sketch is summed over every
passage in Spark. Items longer than a passage are cut into parts of at most a passage. Passages that
lie near a part in the reduced space make its item a candidate; an item counts as leaked where the
longest common subsequence with the words around the passage covers most of the whole item, or
covers enough of it and its answer as well.

Everything that is broadcast has a bound: the benchmark is taken in blocks of about ``ITEMS`` parts,
and each block has its own vocabulary, sketch and pass over the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import table, unused
from corpusmill.llm.wordhash import MARKS, groups, word_hashes
from corpusmill.session import stage

ITEMS = 1000  # benchmark items in a block; a long item counts as its parts
HOP = 16  # words
HOPS = 4  # a passage is so many hops long; the next one starts a hop later
PASSAGE = HOP * HOPS  # words, the most of an item that are looked for as one part
RANK, SPARE = 128, 16  # dimensions of the space, and more of the sketch that they are drawn from
SEED = 7
COMMON = 0.01  # terms of a larger share of the documents don't tell passages apart,
FEW = 10  # unless they are in so few documents
RAREST = 6  # of a part's terms that stay even so
EMPHASIS = 4  # how much the items weigh in the space against all passages of the corpus
COSINE = 0.3  # of a passage and a part, in the space
CONTAINED = 0.35  # of a part's length in the space, found in the passage
COVERED = 0.75  # of an item's words, in order: leaked whatever else
PARAPHRASED = 0.5  # of an item's words: leaked if the answer is there too
ANSWERED = 0.8  # of the answer's words


@dataclass
class Items:
    """A block of benchmark items as words and, once fitted, as vectors."""

    ids: list[str | None]
    words: list[np.ndarray]  # hashes of all words
    answers: list[np.ndarray]  # of the last sentence's words
    terms: np.ndarray  # sorted hashes of the vocabulary
    idf: np.ndarray
    owners: np.ndarray  # the item of each part
    space: np.ndarray | None = None  # terms by dimensions
    vectors: np.ndarray | None = None  # parts by dimensions, of length one
    lengths: np.ndarray | None = None  # of the parts in the space, before


def _answer(text: str) -> str:
    """The last sentence or line of an item that has a word in it."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text) if re.search(r"\w", p)]
    return parts[-1] if parts else ""


def _hashed(texts: list[str]) -> list[np.ndarray]:
    found, bounds = word_hashes([(t or "").lower() for t in texts], MARKS)
    return [found[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def _parts(words: np.ndarray) -> list[np.ndarray]:
    """An item's words in parts of about equal length, none longer than a passage."""
    return np.array_split(words, max(1, -(-len(words) // PASSAGE)))


def _positions(terms: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash in the sorted terms, or -1."""
    if not len(terms):
        return np.full(len(hashes), -1)
    place = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    return np.where(terms[place] == hashes, place, -1)


class _Lookup:
    """``_positions`` for very many hashes: a table over the upper bits settles most of them."""

    BITS = 20

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.able = np.zeros(1 << self.BITS, bool)
        self.able[terms >> np.uint64(64 - self.BITS)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1)
        able = np.flatnonzero(self.able[hashes >> np.uint64(64 - self.BITS)])
        out[able] = _positions(self.terms, hashes[able])
        return out


def _hops(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every hop of every text, and for each text where its hops start."""
    counts = -(-np.diff(bounds) // HOP)
    first = np.concatenate(([0], np.cumsum(counts)))
    within = np.arange(first[-1]) - np.repeat(first[:-1], counts)
    return np.repeat(bounds[:-1], counts) + within * HOP, first


def _passages(texts: list[str], lookup: _Lookup, matrix: np.ndarray):
    """For each passage of the texts that holds a term: the sum of the matrix's rows over its terms.

    Returns hashes, bounds, (position, term) of every term, hop of every term, passages as hop
    numbers, their sums, and the text of each hop.
    """
    hashes, bounds = word_hashes([(t or "").lower() for t in texts], MARKS)
    starts, first = _hops(bounds)
    term = lookup(hashes)
    at = np.flatnonzero(term >= 0)
    term = term[at]
    hop = np.searchsorted(starts, at, side="right") - 1
    owner = np.searchsorted(first, np.arange(len(starts)), side="right") - 1
    live, place = np.unique(hop, return_index=True)
    if not len(live):
        return hashes, bounds, starts, term, hop, live, np.zeros((0, matrix.shape[1]), np.float32), owner
    sums = np.add.reduceat(matrix[term], place, axis=0)
    slots = np.unique(np.concatenate([live - k for k in range(HOPS)]))
    slots = slots[slots >= 0]
    total = np.zeros((len(slots), matrix.shape[1]), np.float32)
    for k in range(HOPS):
        there = np.minimum(np.searchsorted(live, slots + k), len(live) - 1)
        last = np.minimum(slots + k, len(owner) - 1)
        good = (live[there] == slots + k) & (owner[last] == owner[slots])
        total[good] += sums[there[good]]
    return hashes, bounds, starts, term, hop, slots, total, owner


def _document_frequencies(terms):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup = _Lookup(terms.value)
        n = np.zeros(len(terms.value) + 1, np.int64)
        for batch in batches:
            texts = list(batch["text"])
            for start, end in groups(texts):
                hashes, bounds = word_hashes([(t or "").lower() for t in texts[start:end]], MARKS)
                term = lookup(hashes)
                at = np.flatnonzero(term >= 0)
                owner = np.searchsorted(bounds, at, side="right") - 1
                seen = np.unique(owner * len(n) + term[at])
                n += np.bincount(seen % len(n), minlength=len(n))
                n[-1] += end - start
        yield pd.DataFrame({"term": np.arange(len(n)), "n": n})

    return count


def _sketch(items, random):
    """Partial sums of (TF-IDF matrix)ᵀ (TF-IDF matrix) (random matrix) over the passages."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, draws = Items(**items.value), random.value
        lookup = _Lookup(block.terms)
        matrix = (block.idf[:, None] * draws).astype(np.float32)
        total = np.zeros(matrix.shape)
        for batch in batches:
            texts = list(batch["text"])
            for start, end in groups(texts):
                _, _, _, term, hop, slots, sums, owner = _passages(texts[start:end], lookup, matrix)
                if not len(slots):
                    continue
                # a term gets the sums of all passages that contain its hop
                around = np.zeros((len(term), matrix.shape[1]), np.float32)
                for k in range(HOPS):
                    there = np.minimum(np.searchsorted(slots, hop - k), len(slots) - 1)
                    good = slots[there] == hop - k
                    good &= owner[np.maximum(hop - k, 0)] == owner[hop]
                    around[good] += sums[there[good]]
                order = np.argsort(term, kind="stable")
                found, place = np.unique(term[order], return_index=True)
                total[found] += np.add.reduceat(around[order], place, axis=0)
        total *= block.idf[:, None]
        yield pd.DataFrame(
            {"term": np.arange(len(total))} | {f"z{j}": total[:, j] for j in range(total.shape[1])}
        )

    return add


def _common_subsequence(pattern: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, a word of bits at a time."""
    where: dict[int, int] = {}
    for i, word in enumerate(pattern.tolist()):
        where[word] = where.get(word, 0) | 1 << i
    full = (1 << len(pattern)) - 1
    row = full
    for word in text.tolist():
        hit = where.get(word)
        if hit:
            match = row & hit
            row = ((row + match) | (row - match)) & full
    return len(pattern) - row.bit_count()


def _retrieve(items):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = Items(**items.value)
        lookup = _Lookup(block.terms)
        matrix = (block.idf[:, None] * block.space).astype(np.float32)
        across = block.vectors.T.astype(np.float32)
        names = ["doc_id", "item_id", "cosine", "covered", "answered", "leaked"]
        for batch in batches:
            texts, keys = list(batch["text"]), list(batch["doc_id"])
            rows = []
            for start, end in groups(texts):
                hashes, bounds, starts, _, _, slots, sums, owner = _passages(
                    texts[start:end], lookup, matrix
                )
                length = np.maximum(np.linalg.norm(sums, axis=1), 1e-9)
                best: dict[tuple[int, int], tuple] = {}
                for low in range(0, len(slots), 4096):
                    shared = sums[low : low + 4096] @ across
                    cosine = shared / length[low : low + 4096, None]
                    near = (cosine >= COSINE) & (shared >= CONTAINED * block.lengths)
                    met: dict[tuple[int, int], float] = {}  # passage and item: its nearest part
                    for p, k in zip(*np.nonzero(near)):
                        pair = p, block.owners[k]
                        met[pair] = max(float(cosine[p, k]), met.get(pair, -1.0))
                    for (p, i), nearest in met.items():
                        slot = slots[low + p]
                        text, words = owner[slot], block.words[i]
                        begin = max(bounds[text], starts[slot] - len(words))
                        stop = min(bounds[text + 1], starts[slot] + PASSAGE + len(words))
                        around = hashes[begin:stop]
                        covered = _common_subsequence(words, around) / len(words)
                        answer = block.answers[i]
                        answered = _common_subsequence(answer, around) / max(1, len(answer))
                        leaked = covered >= COVERED or (covered >= PARAPHRASED and answered >= ANSWERED)
                        here = (leaked, covered, answered, nearest)
                        if here > best.get((text, i), (False, -1.0)):
                            best[text, i] = here
                rows += [
                    (keys[start + t], block.ids[i], c, v, a, bool(k))
                    for (t, i), (k, v, a, c) in best.items()
                ]
            yield pd.DataFrame(rows, columns=names)

    return find


def _fitted(docs: DataFrame, block: list[tuple[int, str]]) -> Items | None:
    """The items of a block with vocabulary, weights and space; None if they have no words."""
    ids = [None if i is None else str(i) for i, _ in block]
    texts = [t for _, t in block]
    words = _hashed(texts)
    answers = _hashed([_answer(t or "") for t in texts])
    filled = [k for k, w in enumerate(words) if len(w)]
    if not filled:
        return None
    spark = docs.sparkSession
    words, answers = [words[k] for k in filled], [answers[k] for k in filled]
    cut = [_parts(w) for w in words]
    owners = np.repeat(np.arange(len(words)), [len(c) for c in cut])
    parts = [p for c in cut for p in c]
    terms = np.unique(np.concatenate(words))
    texts_only = docs.select("text")
    counted = (
        texts_only.mapInPandas(
            _document_frequencies(spark.sparkContext.broadcast(terms)), "term long, n long"
        )
        .groupBy("term")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    n = np.zeros(len(terms) + 1)
    for row in counted:
        n[row["term"]] = row["n"]
    telling = n[:-1] <= max(FEW, COMMON * n[-1])
    for w in parts:
        own = _positions(terms, np.unique(w))
        telling[own[np.argsort(n[own], kind="stable")[:RAREST]]] = True
    idf = np.log((1 + n[-1]) / (1 + n[:-1][telling])) + 1
    items = Items([ids[k] for k in filled], words, answers, terms[telling], idf, owners)

    rank = min(RANK + SPARE, len(items.terms))
    random = np.random.default_rng(SEED).standard_normal((len(items.terms), rank))
    shared = [spark.sparkContext.broadcast(x) for x in (vars(items), random)]
    columns = [f"z{j}" for j in range(rank)]
    partial = texts_only.mapInPandas(
        _sketch(*shared), "term long, " + ", ".join(f"{c} double" for c in columns)
    )
    sketch = np.zeros((len(items.terms), rank))
    for row in partial.groupBy("term").agg(*[F.sum(c).alias(c) for c in columns]).toLocalIterator():
        sketch[row[0]] = row[1:]
    counts = np.zeros((len(parts), len(items.terms)))
    for k, w in enumerate(parts):
        own = _positions(items.terms, w)
        np.add.at(counts[k], own[own >= 0], 1)
    weighted = counts * items.idf
    own = weighted.T @ (weighted @ random)  # the parts are passages as well
    scale = max(np.linalg.norm(sketch), np.linalg.norm(own)) / np.linalg.norm(own)
    items.space = _eigenvectors(sketch + EMPHASIS * scale * own, random, min(RANK, rank))
    vectors = weighted @ items.space
    items.lengths = np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)
    items.vectors = vectors / items.lengths[:, None]
    return items


def _eigenvectors(sketch: np.ndarray, random: np.ndarray, rank: int) -> np.ndarray:
    """Leading eigenvectors of the matrix M from M·random (the Nyström form)."""
    shift = np.finfo(float).eps * max(1.0, np.linalg.norm(sketch))
    shifted = sketch + shift * random
    inner = random.T @ shifted
    inner = (inner + inner.T) / 2
    values, vectors = np.linalg.eigh(inner)
    good = values > 1e-12 * max(values.max(), 1e-300)
    half = shifted @ (vectors[:, good] / np.sqrt(values[good]))
    left, _, _ = np.linalg.svd(half, full_matrices=False)
    return left[:, :rank]


def leak_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, covered, answered) for each document and item that it leaks.

    Words are runs of letters, digits and _, in lower case. Null, empty and wordless texts and items
    leak nothing. ``cosine`` is of the passage and the item's nearest part. Repeated documents get
    equal rows, one each; repeated items are one item; a null doc_id or item_id is dropped from
    neither side but stays null in the result.
    """
    spark = docs.sparkSession
    # ids as text, since pandas would make a column with nulls a float
    schema = "doc_id string, item_id string, cosine double, covered double, answered double, leaked boolean"
    items = benchmark.select(F.col("item_id").cast("long"), "text").distinct()
    length = F.coalesce(F.regexp_count("text", F.lit(r"[A-Za-z0-9_\x{80}-\x{10FFFF}]+")), F.lit(0))
    parts = items.agg(F.sum(F.greatest(F.lit(1), F.ceil(length / PASSAGE)))).first()[0] or 0
    blocks = -(-parts // ITEMS)
    found = None
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        block = [(r[0], r[1]) for r in own.orderBy("item_id", "text").collect()]
        fitted = _fitted(docs, block)
        if fitted is None:
            continue
        rows = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(
            _retrieve(spark.sparkContext.broadcast(vars(fitted))), schema
        )
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = spark.createDataFrame([], schema)
    ids = [F.col(c).cast("long").alias(c) for c in ("doc_id", "item_id")]
    return found.where("leaked").select(*ids, "cosine", "covered", "answered")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no item, columns as given. Rows are told apart by doc_id and
    text together, so a null or repeated doc_id does no harm."""
    mark = unused(docs, "mark")
    marked = docs.withColumn(mark, F.xxhash64("doc_id", "text"))
    texts = marked.select(F.col(mark).alias("doc_id"), "text")
    leaked = leak_pairs(texts, benchmark).select(F.col("doc_id").alias(mark)).distinct()
    return marked.join(stage(leaked, "leaks"), mark, "left_anti").select(*docs.columns)


def op8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
