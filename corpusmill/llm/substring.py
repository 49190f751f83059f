"""Removing passages that repeat across documents, by compressed full-text indexes.

A passage is a window of ``WINDOW`` consecutive words; it goes where the same words also start in a
document with a smaller id. Windows that are equal must meet in one index without all documents
meeting in all indexes, so each window is routed by its minimizer: the smallest hash among its runs
of ``RUN`` words. Consecutive windows of a document with the same minimizer are one segment. Segments
whose minimizer only one document has cannot repeat and stay where they are. Of the others, equal
ones are one content, owned by its smallest document; the contents are dealt out to shards by
minimizer, and each shard builds an FM-index of its contents and computes the matching statistics of
every content against those with smaller owners.

A minimizer with very many contents is hot: a passage that many documents share, cut off differently
in each. Its segments are cut into single windows, routed by their own hash, so equal ones are one
content and a shard stays bounded however many documents share the passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import table
from corpusmill.llm.fm_index import Index
from corpusmill.llm.wordhash import Ranges, groups, mixed, runs, whole_runs, word_hashes
from corpusmill.session import stage

WINDOW = 50
RUN = 8
LONGEST = 128  # windows in a segment
SHARD_WORDS = 1_200_000  # dealt to an index, about; a step of its search costs much the same for fewer
HOT = 4096  # contents of a minimizer from which on it is hot
HOT_KEYS = 1_000_000  # hot minimizers that are broadcast; if there are more, only hotter ones count
LAST = (1 << 63) - 1  # the place of a null id in the order of documents


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def segments(texts, hot: np.ndarray) -> pd.DataFrame:
    """The segments of some texts: owner (place of the text), start (word), windows, key, content."""
    hashes, bounds = word_hashes(texts)
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("owner", "start", "windows", "key", "content")})
    least = _sliding_least(runs(hashes, RUN), WINDOW - RUN + 1)
    good = whole_runs(bounds, WINDOW, len(hashes))
    owner = np.searchsorted(bounds, np.arange(n), side="right") - 1
    single = np.isin(least, hot) if len(hot) else np.zeros(n, bool)
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | ~good[:-1] | single[1:]
    new &= good
    start = np.flatnonzero(new)
    length = np.add.reduceat(good.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
    # long runs of one minimizer are cut
    cuts = np.maximum(1, -(-length // LONGEST))
    within = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    length = np.minimum(np.repeat(length, cuts) - within * LONGEST, LONGEST)
    start = np.repeat(start, cuts) + within * LONGEST
    content = Ranges(hashes)(start, start + length + WINDOW - 1)
    key = np.where(single[start], mixed(content), least[start])
    return pd.DataFrame(
        {
            "owner": owner[start],
            "start": start - bounds[owner[start]],
            "windows": length,
            "key": key.view(np.int64),
            "content": content.view(np.int64),
        }
    )


def _cut(hot):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = hot.value if hot else np.zeros(0, np.uint64)
        for batch in batches:
            texts = list(batch["text"])
            for start, end in groups(texts):
                found = segments(texts[start:end], keys)
                own = batch.iloc[start:end]
                place = found.pop("owner").to_numpy()
                found.insert(0, "mark", own["mark"].to_numpy()[place])
                found.insert(0, "doc", own["doc"].to_numpy()[place])
                yield found.astype({"start": "int32", "windows": "int32"})

    return run


SEGMENT = "doc long, mark long, start int, windows int, key long, content long"


def _segments_of(docs: DataFrame, hot: np.ndarray | None, label: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(hot) if hot is not None else None
    return stage(docs.mapInPandas(_cut(shared), SEGMENT), label)


def _contents(found: DataFrame) -> DataFrame:
    """(key, content, owner, windows) of the contents whose minimizer several documents have, and
    ``many``, the number of contents of that minimizer."""
    contents = found.groupBy("key", "content").agg(
        F.min("doc").alias("owner"), F.max("doc").alias("last"), F.min("windows").alias("windows")
    )
    keys = contents.groupBy("key").agg(
        F.count(F.lit(1)).alias("many"), F.min("owner").alias("low"), F.max("last").alias("high")
    )
    shared = keys.where("low <> high").select("key", "many")
    return contents.drop("last").join(shared, "key")


def _fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words of the contents that each document owns."""
    for batch in batches:
        texts = list(batch["text"])
        for start, end in groups(texts):
            hashes, bounds = word_hashes(texts[start:end])
            rows = []
            own = batch.iloc[start:end]
            for doc, wanted, first in zip(own["doc"], own["wanted"], bounds):
                for w in wanted:
                    at = first + w["start"]
                    words = hashes[at : at + w["windows"] + WINDOW - 1]
                    rows.append((w["shard"], w["key"], w["content"], doc, words.tobytes()))
            yield pd.DataFrame(rows, columns=["shard", "key", "content", "owner", "words"]).astype(
                {"shard": "int32", "key": "int64", "content": "int64", "owner": "int64"}
            )


def _recurring_runs(sequences: list[np.ndarray]) -> list[tuple[int, int, np.ndarray]]:
    """(sequence, start, words) of the stretches of at least a window in which every run of ``RUN``
    words occurs again.

    A window that repeats lies within such a stretch, so nothing else needs an index. Stretches that
    go may take the last other place of a run with them, hence a few rounds.
    """
    kept = [(i, 0, s) for i, s in enumerate(sequences) if len(s) >= WINDOW]
    for _ in range(4):
        if not kept:
            break
        lengths = np.array([len(w) for _, _, w in kept])
        ends = np.cumsum(lengths)
        words = np.concatenate([w for _, _, w in kept])
        value = runs(words, RUN)
        inside = whole_runs(np.append(0, ends), RUN, len(words))
        _, back, count = np.unique(value, return_inverse=True, return_counts=True)
        again = inside & ((count - np.bincount(back, ~inside, len(count)))[back] > 1)
        if (again == inside).all():
            break
        piece = np.repeat(np.arange(len(kept)), lengths)[: len(again)]
        begins = again.copy()
        begins[1:] &= ~again[:-1] | (piece[1:] != piece[:-1])
        start = np.flatnonzero(begins)
        # a stretch ends with the last run before one that doesn't recur or lies across two pieces
        lone = np.append(np.flatnonzero(~again), len(again))
        stop = lone[np.searchsorted(lone, start)] + RUN - 1
        own = piece[start]
        long = stop - start >= WINDOW
        kept = [
            (kept[p][0], kept[p][1] + a - (ends[p] - lengths[p]), words[a:z])
            for p, a, z in zip(own[long].tolist(), start[long].tolist(), stop[long].tolist())
        ]
    return kept


def _match(rows: pd.DataFrame) -> pd.DataFrame:
    """Which windows of each content also occur in a content with a smaller owner: as stretches of
    words to remove, (key, content, begins, ends)."""
    rows = rows.drop_duplicates(["key", "content"]).sort_values(["owner", "key", "content"])
    owners = rows["owner"].to_numpy("int64")
    places: dict[int, list[np.ndarray]] = {}
    kept = _recurring_runs([np.frombuffer(w, np.uint64) for w in rows["words"]])
    if kept:
        _, rank = np.unique(owners[[i for i, _, _ in kept]], return_inverse=True)
        index = Index([w for _, _, w in kept], rank.astype(np.int32), WINDOW + LONGEST)
        repeated = index.repeated(WINDOW, rank)
        for (i, offset, _), start, length in zip(kept, index.starts, index.lengths):
            own = np.flatnonzero(repeated[start : start + length])
            if len(own):
                places.setdefault(i, []).append(own + offset)
    begins, ends = [], []
    for i in places:
        own = np.concatenate(places[i])
        begin, end = _stretches(own, own + WINDOW)
        begins.append(begin)
        ends.append(end)
    found = rows[["key", "content"]].iloc[list(places)].reset_index(drop=True)
    found["begins"] = pd.Series(begins, dtype=object)
    found["ends"] = pd.Series(ends, dtype=object)
    return found.astype({"key": "int64", "content": "int64"})


def _stretches(begins, ends) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching stretches as one."""
    order = np.argsort(begins, kind="stable")
    begins, ends = np.asarray(begins)[order], np.asarray(ends)[order]
    reach = np.maximum.accumulate(ends)
    new = np.append(True, begins[1:] > reach[:-1])
    return begins[new].astype(np.int32), reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)].astype(np.int32)


def repeated_stretches(docs: DataFrame) -> DataFrame:
    """(doc, mark, begins, ends): the stretches of words to remove from each document of ``docs``
    (doc, mark, text), one row for each segment that has some."""
    found = _segments_of(docs, None, "segments")
    contents = stage(_contents(found), "contents")
    hot = contents.select("key", "many").where(F.col("many") >= HOT).distinct()
    limit, keys = HOT, hot.count()
    while keys > HOT_KEYS:
        limit *= 2
        keys = hot.where(F.col("many") >= limit).count()
    if keys:
        chosen = hot.where(F.col("many") >= limit).select("key").toLocalIterator()
        values = np.sort(np.fromiter((r[0] for r in chosen), np.int64, keys).view(np.uint64))
        found = _segments_of(docs, values, "segments")
        contents = stage(_contents(found), "contents")
    # the windows of a minimizer with one content are in no other content: their owner keeps them
    mixed_up = contents.where("many > 1")
    size = mixed_up.agg(F.sum(F.col("windows") + WINDOW - 1).alias("n")).first()["n"] or 0
    shards = max(1, -(-size // SHARD_WORDS))

    # of the owner's segments with a content, one is fetched
    owned = mixed_up.join(found.withColumnRenamed("doc", "owner").drop("windows"), ["key", "content", "owner"])
    first = owned.groupBy("key", "content", "owner", "windows").agg(F.min(F.struct("start", "mark")).alias("at"))
    first = first.select("key", "content", "owner", "windows", "at.start", "at.mark")
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")
    wanted = (
        first.select("owner", "mark", F.struct("start", "windows", "key", "content", shard).alias("w"))
        .groupBy("owner", "mark")
        .agg(F.collect_list("w").alias("wanted"))
    )
    texts = docs.join(wanted.withColumnRenamed("owner", "doc"), ["doc", "mark"])
    pieces = texts.select("doc", "wanted", "text").mapInPandas(
        _fetch, "shard int, key long, content long, owner long, words binary"
    )
    matched = stage(
        pieces.groupBy("shard").applyInPandas(
            _match, "key long, content long, begins array<int>, ends array<int>"
        ),
        "matched",
    )
    # other documents with a content have all of it from its owner
    whole = F.col("doc") > F.col("owner")
    both = found.join(contents.select("key", "content", "owner"), ["key", "content"]).join(
        matched, ["key", "content"], "left"
    )
    own = F.col("begins").isNotNull()
    return both.where(whole | own).select(
        "doc",
        "mark",
        F.when(whole, F.array("start")).otherwise(F.transform("begins", lambda b: b + F.col("start"))).alias("begins"),
        F.when(whole, F.array(F.col("start") + F.col("windows") + WINDOW - 1))
        .otherwise(F.transform("ends", lambda e: e + F.col("start")))
        .alias("ends"),
    )


def _keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text, begins, ends in zip(batch["text"], batch["begins"], batch["ends"]):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            keep, removed = words, 0
            if begins is not None and len(begins):
                keep, at = [], 0
                for begin, end in zip(*_stretches(begins, ends)):
                    keep += words[at:begin]
                    at = end
                keep += words[at:]
                removed = len(words) - len(keep)
            rows.append((len(words), removed, b" ".join(keep).decode("utf-8", "surrogatepass")))
        yield pd.concat(
            [
                batch[["doc_id"]].reset_index(drop=True),
                pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"]),
            ],
            axis=1,
        )


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of each row of ``docs`` (doc_id, text).

    ``kept`` is the words that stay, joined by one space. A null text has no words. A null id comes
    after all others. Rows that share an id are never smaller than each other, so they lose nothing
    to one another; equal rows lose the same words.
    """
    given = docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
        F.xxhash64("text").alias("mark"),
        "text",
    )
    gone = stage(repeated_stretches(given.drop("doc_id")), "stretches")
    gone = gone.groupBy("doc", "mark").agg(
        F.flatten(F.collect_list("begins")).alias("begins"), F.flatten(F.collect_list("ends")).alias("ends")
    )
    return (
        given.join(gone, ["doc", "mark"], "left")
        .select(F.col("doc_id").cast("string"), "text", "begins", "ends")
        .mapInPandas(_keep, "doc_id string, n_words long, n_removed long, kept string")
        .select(F.col("doc_id").cast("long"), "n_words", "n_removed", "kept")
    )


def _sha256(kept: Column) -> Column:
    return F.sha2(kept.cast("binary"), 256)


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", _sha256(F.col("kept")).alias("kept_sha256"))
