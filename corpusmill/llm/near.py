"""Near-duplicates by ProbMinHash signatures, banding and exact verification.

Shingles are five words; a shingle that occurs n times in a document weighs 1 + ln(n). Each shingle
is a Poisson process whose rate is its weight: its arrivals fall on registers at random, a register
keeps the shingle that arrives first, and a shingle stops as soon as its time has passed the latest
register. Two documents agree in a register with the probability Jaccard of their weights, which is
the Jaccard of their shingle sets where nothing repeats. As repeats may be uneven, every document is
also banded by a signature with all weights at one, which agrees by the Jaccard of the sets. Pairs
that meet in a band are then compared exactly, on their shingle sets.

Equal texts are one node from the start. Every node is first compared with the smallest nodes of its
band buckets, those that share most bands with it. In a bucket whose nodes are still in several
components afterwards, all nodes outside its largest component are compared with every node of
another component, exactly and where their shingle sets meet, so that only what joins two components
comes out, and one pass is enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import packed, table
from corpusmill.llm.components import components
from corpusmill.llm.wordhash import groups, mixed, shingles
from corpusmill.session import stage

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4  # a pair at 0.8 is missed by all bands of weights of one with probability 3e-5
REGISTERS = BANDS * ROWS
CENTRES = 3  # of its buckets that a node is compared with before anything else, by shared bands
PART = 512  # nodes of a bucket that a task holds while others stream past, about,
PART_SHINGLES = 1 << 21  # and of their shingles
STRIPE = 4096  # nodes that stream past them, about
STEP = 128  # of these at a time
MATCHES = 1 << 20  # of shingles that are counted at a time
TEXTS = 256  # compared with one centre in a group

_STEP = np.uint64(0x9E3779B97F4A7C15)


def signatures(
    texts, size: int = WORDS, registers: int = REGISTERS, weighted: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """One row of 32-bit registers for each text, and whether the text has words at all."""
    owner, shingle, count = shingles(texts, size)
    weight = 1.0 + np.log(count) if weighted else np.ones(len(count))
    return _registers(len(texts), owner, shingle, weight, registers)


def _registers(
    n: int, owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, registers: int = REGISTERS
) -> tuple[np.ndarray, np.ndarray]:
    least = np.full(n * registers, np.inf)
    kept = np.zeros(n * registers, np.uint32)
    time = np.zeros(len(shingle))
    state = mixed(shingle)
    while len(shingle):
        state = state + _STEP
        draw = mixed(state)
        unit = ((draw >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)
        time = time - np.log(unit) / weight
        place = owner * registers + (mixed(draw) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(least, place, time)
        first = time == least[place]
        kept[place[first]] = (shingle[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        latest = least.reshape(n, registers).max(axis=1)
        going = time < latest[owner]
        owner, shingle, weight = owner[going], shingle[going], weight[going]
        time, state = time[going], state[going]
    found = np.isfinite(least.reshape(n, registers)[:, 0])
    return kept.reshape(n, registers), found


def band_keys(signature: np.ndarray, bands: int = BANDS, first: int = 0) -> np.ndarray:
    """One 64-bit key for each band of each signature; bands are numbered from ``first``."""
    rows = signature.reshape(len(signature), bands, -1).astype(np.uint64)
    key = np.broadcast_to(np.arange(first, first + bands, dtype=np.uint64), rows.shape[:2])
    for i in range(rows.shape[2]):
        key = mixed(key * _STEP + rows[:, :, i])
    return key.view(np.int64)


def _keys(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The band keys of each text, whether it has words, and whether a shingle repeats in it.

    The first ``BANDS`` columns are of weights of one, the others of the weights by count. Where
    nothing repeats the two signatures are equal, and the others are 0.
    """
    owner, shingle, count = shingles(texts, WORDS)
    unit, found = _registers(len(texts), owner, shingle, np.ones(len(count)))
    keys = np.zeros((len(texts), 2 * BANDS), np.int64)
    keys[:, :BANDS] = band_keys(unit)
    repeats = np.zeros(len(texts), bool)
    repeats[owner[count > 1]] = True
    own = repeats[owner]
    if own.any():
        weighted, _ = _registers(len(texts), owner[own], shingle[own], 1.0 + np.log(count[own]))
        keys[repeats, BANDS:] = band_keys(weighted[repeats], first=BANDS)
    return keys, found, repeats


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = list(batch["text"])
        for start, end in groups(texts):
            keys, found, repeats = _keys(texts[start:end])
            part = batch.iloc[start:end]
            out = pd.DataFrame(
                {
                    "id": part["id"].to_numpy(),
                    "digest": part["digest"].to_numpy(),
                    "keys": [k if r else k[:BANDS] for k, r in zip(keys, repeats)],
                }
            )
            yield out[found]


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by group, the centre first: the pairs of centre and other that are similar. A
    centre whose id is repeated may have several texts; the other is similar to one of them."""
    group, centre, centre_sets = None, None, []
    for batch in batches:
        texts = list(batch["text"])
        names = list(zip(batch["centre"], batch["part"]))
        nodes = list(batch["node"])
        pairs = []
        for start, end in groups(texts):
            owner, shingle, _ = shingles(texts[start:end], WORDS)
            cuts = np.searchsorted(owner, np.arange(end - start + 1))
            for i in range(start, end):
                own = shingle[cuts[i - start] : cuts[i - start + 1]]
                if names[i] != group:
                    group, centre, centre_sets = names[i], nodes[i], [own]
                elif nodes[i] == centre:
                    centre_sets.append(own)
                elif any(_jaccard(own, s) >= SIMILARITY for s in centre_sets):
                    pairs.append((centre, nodes[i]))
        yield pd.DataFrame(pairs, columns=["a", "b"]).astype("int64")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingle sets have the similarity.

    Each text travels once for each centre (a) that it is compared with. A centre with many
    partners is cut into groups of about ``TEXTS``, each with a copy of the centre's text.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TEXTS).cast("int").alias("parts"))
    others = pairs.join(sizes, "a").select(
        F.col("a").alias("centre"),
        F.pmod(F.hash("b"), "parts").alias("part"),
        F.col("b").alias("node"),
    )
    centres = sizes.select(
        F.col("a").alias("centre"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.col("a").alias("node"),
    )
    return (
        others.unionByName(centres)
        .join(texts, "node")
        .repartition("centre", "part")
        .withColumn("other", (F.col("node") != F.col("centre")).cast("int"))
        .sortWithinPartitions("centre", "part", "other", "node")
        .mapInPandas(_compare, "a long, b long")
        .distinct()
    )


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = list(batch["text"])
        for start, end in groups(texts):
            owner, shingle, _ = shingles(texts[start:end], WORDS)
            cuts = np.searchsorted(owner, np.arange(end - start + 1))
            yield pd.DataFrame(
                {
                    "node": batch["node"].iloc[start:end].to_numpy(),
                    "size": np.diff(cuts),
                    "shingles": [shingle[i:j].tobytes() for i, j in zip(cuts, cuts[1:])],
                }
            )


class Held:
    """Shingle sets by shingle, with the component of each."""

    def __init__(self, batches: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(batches)
        self.node, self.component, sets = rows["node"].to_numpy(), rows["component"].to_numpy(), _arrays(rows["shingles"])
        self.size = np.array([len(x) for x in sets])
        value, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(value, kind="stable")
        self.owner = owner[order]
        self.value, self.start = np.unique(value[order], return_index=True)
        self.end = np.append(self.start[1:], len(order))

    def shared(self, sets: list[np.ndarray]) -> np.ndarray:
        """How many shingles each of ``sets`` (rows) shares with each set that is held (columns)."""
        width = len(self.size)
        counts = np.zeros(len(sets) * width, np.int64)
        value, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(self.value, value), len(self.value) - 1)
        known = self.value[at] == value
        at, row = at[known], row[known]
        n = self.end[at] - self.start[at]
        reached = np.cumsum(n)
        first = 0
        while first < len(at):
            done = reached[first - 1] if first else 0
            last = max(int(np.searchsorted(reached, done + MATCHES, side="right")), first + 1)
            part = n[first:last]
            inside = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)
            owner = self.owner[np.repeat(self.start[at[first:last]], part) + inside]
            counts += np.bincount(np.repeat(row[first:last], part) * width + owner, minlength=len(counts))
            first = last
        return counts.reshape(len(sets), width)


def _arrays(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group (key, part, stripe), what is held first: the pairs of components that
    similar texts join (a, b). What is joined already within the group is left out."""
    group, given, held, root = None, [], None, {}

    def top(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    def joined(rows: pa.RecordBatch) -> list[tuple[int, int]]:
        sets, node, component = _arrays(rows["shingles"]), rows["node"].to_numpy(), rows["component"].to_numpy()
        main = rows["main"].to_numpy(zero_copy_only=False)
        both = held.shared(sets)
        size = np.array([len(x) for x in sets])
        near = both / np.maximum(1, size[:, None] + held.size[None, :] - both) >= SIMILARITY
        near &= component[:, None] != held.component[None, :]
        near &= main[:, None] | (node[:, None] > held.node[None, :])  # two that are both held meet once
        pairs = []
        for i, k in zip(*np.nonzero(near)):
            a, b = sorted((top(int(component[i])), top(int(held.component[k]))))
            if a != b:
                root[b] = a
                pairs.append((a, b))
        return pairs

    for batch in batches:
        pairs = []
        names = np.stack([batch[c].to_numpy() for c in ("key", "part", "stripe", "kind")], axis=1)
        edges = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
        for begin, end in zip([0, *edges], [*edges, len(names)]):
            if begin == end:
                continue
            rows, now = batch.slice(begin, end - begin), tuple(names[begin, :3])
            if now != group:
                group, given, held, root = now, [], None, {}
            if names[begin, 3] == 0:
                given.append(rows)
            elif given:
                held = held or Held(given)
                for at in range(0, rows.num_rows, STEP):
                    pairs += joined(rows.slice(at, STEP))
        a, b = zip(*pairs) if pairs else ((), ())
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _in_components(rows: DataFrame, found: DataFrame, node: str, name: str) -> DataFrame:
    named = found.select(F.col("node").alias(node), F.col("component").alias(name))
    return rows.join(named, node, "left").withColumn(name, F.coalesce(name, node))


def _unsettled(members: DataFrame, found: DataFrame) -> DataFrame:
    """(key, main, node, component) of the buckets that hold several components; ``main`` is the
    component with most nodes of the bucket."""
    named = _in_components(members, found, "node", "component")
    parts = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    several = (
        parts.groupBy("key")
        .agg(F.max(F.struct("n", F.col("component").alias("main"))).alias("top"), F.count(F.lit(1)).alias("parts"))
        .where("parts > 1")
        .select("key", "top.main")
    )
    return named.join(several, "key")


def _across(unsettled: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of components (a, b) that similar texts of a shared bucket join.

    A bucket's nodes outside its main component are dealt into parts of bounded size, all its nodes
    into stripes, and every part meets every stripe; the main component never meets itself.
    """
    minor = F.col("component") != F.col("main")
    sized = unsettled.join(sets.groupBy("node").agg(F.sum("size").alias("size")), "node")
    counts = sized.groupBy("key").agg(
        F.ceil(F.greatest(F.count_if(minor) / PART, F.sum(F.when(minor, F.col("size"))) / PART_SHINGLES))
        .cast("int")
        .alias("parts"),
        F.ceil(F.count(F.lit(1)) / STRIPE).cast("int").alias("stripes"),
    )
    dealt = unsettled.join(counts, "key").select("*", F.hash("node").alias("mark"))

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    held = dealt.where(minor).select("*", F.lit(0).alias("kind"), F.pmod("mark", "parts").alias("part"), every("stripes").alias("stripe"))
    past = dealt.select("*", F.lit(1).alias("kind"), every("parts").alias("part"), F.pmod("mark", "stripes").alias("stripe"))
    columns = ["key", "part", "stripe", "kind", "node", "component", (~minor).alias("main")]
    met = (
        held.select(*columns)
        .unionByName(past.select(*columns))
        .join(sets.select("node", "shingles"), "node")
        .repartition("key", "part", "stripe")
        .sortWithinPartitions("key", "part", "stripe", "kind")
    )
    return met.mapInArrow(_meet, "a long, b long").distinct()


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, digest, class_id) for each distinct (key, text digest) of ``docs``.

    ``class_id`` is the smallest key of the connected component of near-duplicates. Rows with equal
    texts are always in one class. A null, empty or blank text has no shingle and is a class of its
    own, named by its own key; a text of fewer than five words has one shingle, all its words. A
    null key is replaced by a hash of the text. Rows that share a key count as one document.
    """
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    keyed = docs.select(
        F.coalesce(F.col(key).cast("long"), F.xxhash64(text)).alias("id"),
        digest.alias("digest"),
        F.col(text).alias("text"),
    )
    signed = stage(keyed.mapInPandas(_sign, "id long, digest string, keys array<long>"), "signed")
    nodes = signed.groupBy("digest").agg(F.min("id").alias("node"))
    own = stage(signed.select("id", "digest").distinct().join(nodes, "digest"), "nodes")
    chosen = own.where("id = node").select("node", "digest")
    buckets = (
        signed.withColumnRenamed("id", "node")
        .join(chosen, ["node", "digest"], "left_semi")
        .select("node", F.explode("keys").alias("key"))
        .distinct()
    )
    met = buckets.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stage(buckets.join(met, "key").select("key", "node", "a"), "buckets")
    wanted = shared.select("node").distinct().join(chosen, "node")
    texts = stage(
        keyed.withColumnRenamed("id", "node")
        .join(wanted, ["node", "digest"], "left_semi")
        .dropDuplicates(["node", "digest"])
        .select("node", "text"),
        "texts",
    )
    # a node's likeliest centres come first
    bands = shared.where("node <> a").groupBy("a", F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    likeliest = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("n"), "a"))
    pairs = bands.where("n > 1").withColumn("place", likeliest).where(F.col("place") <= CENTRES).select("a", "b")
    links = stage(verified(pairs, texts), "links")
    found = stage(components(links), "components")

    members = shared.select("key", "node")
    unsettled = stage(_unsettled(members, found), "unsettled")
    left = unsettled.select("node").distinct()
    texts = stage(texts.join(left, "node", "left_semi"), "texts")
    sets = stage(texts.mapInPandas(_sets, "node long, size long, shingles binary"), "sets")
    new = stage(_across(unsettled, sets), "links")
    if new.take(1):
        known = found.select(F.col("component").alias("a"), F.col("node").alias("b"))
        found = stage(components(known.unionByName(new)), "components")
    classes = own.join(found, "node", "left").select(
        F.col("id").alias(key), "digest", F.coalesce("component", "node").alias("class_id")
    )
    return classes.groupBy(key, "digest").agg(F.min("class_id").alias("class_id"))


def _named(docs: DataFrame) -> tuple[DataFrame, str]:
    """(key, mark, class_id, row): the key that takes part, the text's digest, the class, and all
    columns of ``docs`` as one, whose name is returned."""
    classes = stage(near_classes(docs), "classes")
    given, row = packed(docs, "doc_id", "text")
    keyed = given.select(
        F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key"),
        F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("mark"),
        row,
    )
    found = classes.select(F.col("doc_id").alias("key"), F.col("digest").alias("mark"), "class_id")
    named = keyed.join(found, ["key", "mark"], "left")
    return named.withColumn("class_id", F.coalesce("class_id", "key")), row


def with_class(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``class_id``, which replaces a column of that name; one row for each row."""
    named, row = _named(docs)
    others = [F.col(f"{row}.{c}") for c in docs.columns if c != "class_id"]
    return named.select(*others, "class_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents whose key names their class: one row of each, columns as given.

    Of repeated rows with the same key and text one stays. A row without doc_id goes by the hash of
    its text.
    """
    named, row = _named(docs)
    first = named.where(F.col("class_id") == F.col("key")).dropDuplicates(["key", "mark"])
    return first.select(f"{row}.*")


def op9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_class(docs).select("doc_id", "class_id")
