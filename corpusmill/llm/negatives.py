"""Hard-negative mining with exact scores from a residue-number-system matrix product.

Vectors are whole numbers. Their components are taken modulo several small primes, symmetric about 0;
for each prime one float32 matrix product of anchors and candidates gives all inner products modulo
it, exactly, because the products of ``SLAB`` residues add up to less than 2^24. Mixed-radix
reconstruction by the Chinese remainder theorem gives the signed scores; how many primes are needed
follows from the longest vector. A selection then keeps, for each anchor, the best scores inside a
window: first of the rows with its label (positives), then, for each positive, of the rows with another
label whose score lies within the given shares of the positive's.

Anchors go in groups and candidates in stripes; one task takes a group's anchors and streams the
stripe past them, so memory follows the group, not the stripe. What moves is each anchor once for each
stripe and each candidate once for each group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import table
from corpusmill.session import stage

SCALE = 256
EVERY = 50  # ids divisible by it are anchors
POSITIVES = 5
NEGATIVES = 3
WINDOW = (50, 95)  # per cent of the positive's score
NOISE, LABELS = 7, 10  # where the id is divisible by NOISE, the next of LABELS labels counts
SLAB = 64  # components whose products are added in float32
LARGEST = 1024  # primes are below it: 64 products of residues up to 511 stay under 2^24
GROUP = 65536  # anchors of a group, about
STRIPE = 262144  # candidates of a stripe at most, about
LEAST = 1024  # candidates that are worth a stripe of their own
BITS = 52  # of a score at most, so that the window's hundredfold fits into 64
TILE = 1024  # anchors and candidates of one matrix product
LOWEST = np.iinfo(np.int64).min


def moduli(bound: int) -> list[int]:
    """Primes under ``LARGEST``, largest first, whose product tells apart all scores from -bound to bound."""
    chosen, product = [], 1
    for p in range(LARGEST - 1, 2, -2):
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            chosen.append(p)
            product *= p
            if product > 2 * bound + 1:
                break
    return chosen


def residues(matrix: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """The matrix modulo each prime, symmetric about 0, as float32."""
    parts = []
    for p in primes:
        rest = matrix % p
        parts.append(np.where(rest > p // 2, rest - p, rest).astype(np.float32))
    return parts


def products(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact inner products of the rows of two matrices from their residues."""
    score, radix = np.zeros((len(left[0]), len(right[0])), np.int64), 1
    for p, a, b in zip(primes, left, right):
        rest = np.zeros(score.shape, np.int64)
        for at in range(0, a.shape[1], SLAB):
            rest += (a[:, at : at + SLAB] @ b[:, at : at + SLAB].T).astype(np.int64)
        digit = (rest - score) % p * pow(radix, -1, p) % p
        score += radix * digit
        radix *= p
    return np.where(score > radix // 2, score - radix, score)


class Selection:
    """The ``k`` best (score, id) of each slot; a slot takes scores from its low to its high."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high = low, high
        self.score = np.full((len(low), k), LOWEST)
        self.id = np.zeros((len(low), k), np.int64)

    def offer(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """A tile of scores: a row for each of ``slots`` and a column for each candidate."""
        least = np.maximum(self.low[slots], self.score[slots, -1])
        row, column = np.nonzero(
            allowed & (scores >= least[:, None]) & (scores <= self.high[slots][:, None])
        )
        if not len(row):
            return
        touched, place = np.unique(row, return_inverse=True)
        held = slots[touched]
        k = self.score.shape[1]
        owner = np.concatenate([place, np.repeat(np.arange(len(held)), k)])
        score = np.concatenate([scores[row, column], self.score[held].ravel()])
        which = np.concatenate([ids[column], self.id[held].ravel()])
        order = np.lexsort((which, ~score, owner))  # ~ reverses the order without overflow
        owner, score, which = owner[order], score[order], which[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        best = rank < k
        self.score[held[owner[best]], rank[best]] = score[best]
        self.id[held[owner[best]], rank[best]] = which[best]

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, score, id) of everything that was kept."""
        slot, at = np.nonzero(self.score > LOWEST)
        return slot, self.score[slot, at], self.id[slot, at]


def _matrix(column: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Vectors as rows; a shorter one counts as padded with zeros, a longer one is cut to ``width``."""
    values, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    width = int(sizes.max(initial=0)) if width is None else width
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width).astype(np.int64)
    made, row = np.zeros((len(sizes), width), np.int64), np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    made[row[at < width], at[at < width]] = values[at < width]
    return made


class Cell:
    """A group's anchors, and what is best for them in the candidates seen so far."""

    def __init__(self, batches: list[pa.RecordBatch], primes: list[int], same: bool, k: int):
        anchors = pa.Table.from_batches(batches).combine_chunks()
        self.ids, self.labels = anchors["id"].to_numpy(), anchors["label"].to_numpy()
        matrix = _matrix(anchors["impacts"].combine_chunks())
        self.width, self.primes, self.same = matrix.shape[1], primes, same
        self.parts = residues(matrix, primes)
        # an anchor with fewer slots than others gets empty ones, which no positive asks for
        low, high = (_matrix(anchors[c].combine_chunks()) for c in ("low", "high"))
        self.slots = low.shape[1]
        self.best = Selection(low.ravel(), high.ravel(), k)

    def offer(self, batch: pa.RecordBatch) -> None:
        ids, labels = batch["id"].to_numpy(), batch["label"].to_numpy()
        parts = residues(_matrix(batch["impacts"], self.width), self.primes)
        for c in range(0, len(ids), TILE):
            right = [p[c : c + TILE] for p in parts]
            for a in range(0, len(self.ids), TILE):
                scores = products([p[a : a + TILE] for p in self.parts], right, self.primes)
                allowed = (self.labels[a : a + TILE, None] == labels[None, c : c + TILE]) == self.same
                allowed &= self.ids[a : a + TILE, None] != ids[None, c : c + TILE]
                rows = np.arange(a, a + len(scores))
                for slot in range(self.slots):
                    self.best.offer(rows * self.slots + slot, scores, ids[c : c + TILE], allowed)

    def results(self) -> pa.RecordBatch:
        slot, score, which = self.best.results()
        columns = {
            "anchor_id": pa.array(self.ids[slot // max(self.slots, 1)], pa.int64()),
            "slot": pa.array(slot % max(self.slots, 1), pa.int32()),
            "score": pa.array(score, pa.int64()),
            "id": pa.array(which, pa.int64()),
        }
        return pa.RecordBatch.from_pydict(columns)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(cell, kind, rows) of each stretch of rows of one cell and kind."""
    cell, kind = batch["cell"].to_numpy(), batch["kind"].to_numpy()
    edges = np.flatnonzero((np.diff(cell) != 0) | (np.diff(kind) != 0)) + 1
    for begin, end in zip([0, *edges], [*edges, len(cell)]):
        if end > begin:
            yield int(cell[begin]), int(kind[begin]), batch.slice(begin, end - begin)


def _search(primes: list[int], same: bool, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, anchors, cell = None, [], None
        for batch in batches:
            for number, kind, rows in _runs(batch):
                if number != at:
                    if cell:
                        yield cell.results()
                    at, anchors, cell = number, [], None
                if kind == 0:
                    anchors.append(rows)
                elif anchors:
                    cell = cell or Cell(anchors, primes, same, k)
                    cell.offer(rows)
        if cell:
            yield cell.results()

    return search


def _best(
    rows: DataFrame, anchors: DataFrame, sizes: tuple[int, int], primes: list[int], same: bool, k: int
) -> DataFrame:
    """(anchor_id, slot, rank, id, score): the ``k`` best rows of each slot of each anchor.

    ``anchors`` has id, label, impacts, and the slots' low and high.
    """
    groups = max(1, -(-sizes[1] // GROUP))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stripes = min(max(-(-sizes[0] // STRIPE), -(-parts // groups)), max(1, sizes[0] // LEAST))
    every = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (groups, stripes)]
    group = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")
    stripe = F.pmod(F.xxhash64("id", "impacts"), F.lit(stripes)).cast("int")
    columns = ["id", "label", "impacts", "low", "high"]
    left = anchors.withColumns({"kind": F.lit(0), "group": group}).withColumn("stripe", every[1])
    empty = F.lit(None).cast("array<bigint>")
    right = rows.withColumns({"kind": F.lit(1), "stripe": stripe, "low": empty, "high": empty}).withColumn(
        "group", every[0]
    )
    cell = (F.col("group") * stripes + F.col("stripe")).cast("int").alias("cell")
    both = left.select(cell, "kind", *columns).unionByName(right.select(cell, "kind", *columns))
    met = both.repartition(min(groups * stripes, 4 * parts), "cell").sortWithinPartitions("cell", "kind")
    found = met.mapInArrow(_search(primes, same, k), "anchor_id long, slot int, score long, id long")
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(vectors: DataFrame) -> DataFrame:
    """(id, label, impacts) of the rows that take part, with the noise in the labels."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("wide", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    label = F.col("label").cast("long")
    moved = F.when(F.pmod(F.col("vec_id"), F.lit(NOISE)) == 0, F.pmod(label + 1, F.lit(LABELS))).otherwise(label)
    return (
        vectors.select(F.col("vec_id").cast("long").alias("id"), moved.alias("label"), wide.alias("wide"))
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("wide").isNotNull())
        .where(~F.coalesce(bad, F.lit(True)))
        .select("id", "label", F.transform("wide", lambda x: F.floor(x * SCALE).cast("long")).alias("impacts"))
    )


def mine(
    rows: DataFrame,
    every: int = EVERY,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    window: tuple[int, int] = WINDOW,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from whole-number
    vectors ``rows`` (id, label, impacts), none of them null.

    Anchors are the ids divisible by ``every``. Rows with an anchor's id are its own, so neither
    positives nor negatives of it; if they differ, the one of the smallest (label, impacts) is the
    anchor. Other repeated rows count each, and a positive that is there twice has its negatives
    twice. A shorter vector counts as padded with zeros. A positive without negatives, and an anchor
    without positives, has no row; an empty table gives none. Scores must fit into ``BITS`` bits,
    else the search fails.
    """
    rows = stage(rows.select("id", "label", "impacts"), "impacts")
    is_anchor = F.pmod("id", F.lit(every)) == 0
    length = F.aggregate("impacts", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    size = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_anchor).alias("anchors"), F.max(length).alias("length")
    ).first()
    longest = (size["length"] or 0) * (1 + 1e-9) + 1  # no score is above it: Cauchy and Schwarz
    if longest >= 1 << BITS:
        raise ValueError(f"scores of these vectors don't fit into {BITS} bits")
    primes = moduli(int(longest))
    sizes = (size["n"], size["anchors"])
    rows = rows.withColumn("impacts", F.col("impacts").cast("array<int>"))
    own = rows.where(is_anchor).groupBy("id").agg(F.min(F.struct("label", "impacts")).alias("row"))
    own = stage(own.select("id", "row.label", "row.impacts"), "anchors")

    def bounds(low, high):
        return own.withColumns({"low": F.array(F.lit(low)), "high": F.array(F.lit(high))})

    widest = np.iinfo(np.int64).max
    near = stage(_best(rows, bounds(-widest, widest), sizes, primes, True, positives), "positives")
    near = near.select(
        "anchor_id",
        (F.col("rank") - 1).alias("slot"),
        F.col("id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )

    share = {c: F.lit(w).cast("bigint") * F.col("positive_score") for c, w in zip(("low", "high"), window)}
    up, down = F.expr("(low + pmod(-low, 100)) div 100"), F.expr("(high - pmod(high, 100)) div 100")
    slots = near.withColumns(share).select("anchor_id", "slot", up.alias("low"), down.alias("high"))
    gathered = slots.groupBy(F.col("anchor_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("slot", "low", "high"))).alias("slots")
    )
    windowed = own.join(gathered, "id").select(
        "id", "label", "impacts", F.col("slots.low").alias("low"), F.col("slots.high").alias("high")
    )
    hard = _best(rows, windowed, sizes, primes, False, negatives)
    return hard.join(near, ["anchor_id", "slot"]).select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(usable(table(spark, sf_dir, "embeddings")))


SQL = f"""
with given as (
  select vec_id, case when vec_id % {NOISE} = 0 then (label + 1) % {LABELS} else label end as label,
         list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
anchors as (
  select vec_id, label, v from given where vec_id % {EVERY} = 0
  qualify row_number() over (partition by vec_id order by label, v) = 1),
scored as (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same,
         coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])), 0)::bigint as score
  from anchors a join given c on a.vec_id <> c.vec_id),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score,
         row_number() over (partition by anchor_id order by score desc, vec_id) as place
  from scored where same qualify place <= {POSITIVES}),
negatives as (
  select p.anchor_id, positive_id, positive_score, n.vec_id as negative_id, n.score as negative_score,
         row_number() over (partition by p.anchor_id, place order by n.score desc, n.vec_id)::int as rank
  from positives p join scored n on n.anchor_id = p.anchor_id and not n.same
    and {WINDOW[0]} * positive_score <= 100 * n.score and 100 * n.score <= {WINDOW[1]} * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score
from negatives where rank <= {NEGATIVES}"""
