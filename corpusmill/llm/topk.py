"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors are quantised to whole numbers. A shard keeps, for each component, postings of the vectors
in which it isn't zero, in segments of descending impact: the first segment holds the largest
components of all its vectors, and so on. Queries are scored segment by segment, and a segment costs
its postings only. After each one, what the remaining segments can still add is bounded, for each
pair, by the largest impact left and by the lengths of the two remainders; a query is finished, and
leaves the later segments, only when this proves which few vectors can be among its best, and those
are scored exactly. What a query has found in one block of a shard is a bar for its next.

Candidates go in shards and queries in groups of bounded size. One task takes a shard, builds its
postings once and streams a group of queries past them, so memory follows the shard, not the
queries. What moves is each candidate once for each group and each query once for each shard; at most
``K`` rows a query and shard come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import table
from corpusmill.session import stage

K = 5
SCALE = 256
EVERY = 50  # ids divisible by it are queries
SHARD = 65536  # candidates of a shard, about
POSTINGS = 1 << 22  # of a shard, about
LEAST = 1024  # candidates that are worth a shard of their own
QUERIES = 65536  # queries of a group, about
BLOCK = 8192  # of its candidates that are scored together
TILE = 32  # queries that are scored together
SEGMENTS = 4
FEW = 32  # possible members that are scored one by one


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, impacts): floor(256 x) of each component. Rows with a null id, a null vector or a null
    or non-finite component are left out."""
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists(
        wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    return (
        vectors.select(F.col(key).cast("long").alias("id"), wide.alias("wide"))
        .where(F.col("id").isNotNull() & F.col("wide").isNotNull())
        .where(~F.coalesce(bad, F.lit(True)))
        .select("id", F.transform("wide", lambda x: F.floor(x * SCALE).cast("long")).alias("impacts"))
    )


class Index:
    """A block's postings by descending impact, with bounds on what is left after each segment."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, segments: int = SEGMENTS):
        self.ids, self.matrix = ids, matrix
        impact = np.abs(matrix.T)
        filled = impact[impact > 0]
        shares = np.arange(1, segments) / segments
        cuts = np.unique(np.quantile(filled, shares).astype(np.int64))[::-1] if filled.size else []
        self.segments = []  # (postings, largest impact left, length of what is left of each vector)
        upper = np.inf
        for lower in [*(c for c in cuts if c), 0]:
            component, vector = np.nonzero((impact <= upper) & (impact > lower))
            bounds = np.searchsorted(component, np.arange(len(impact) + 1))
            postings = [
                (c, vector[low:high], matrix[vector[low:high], c].astype(np.float64)[:, None])
                for c, (low, high) in enumerate(zip(bounds[:-1], bounds[1:]))
                if low < high
            ]
            rest = np.where(impact <= lower, impact, 0)
            left = np.sqrt((rest.astype(np.float64) ** 2).sum(axis=0))
            self.segments.append((postings, float(rest.max(initial=0)), left))
            upper = lower

    def best(
        self, queries: np.ndarray, own: np.ndarray, k: int = K, floor: np.ndarray | float = -np.inf
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """(scores, ids) of each query's best that reach its ``floor``, ties to the smaller id;
        ``own`` is the id left out."""
        wide = queries.T.astype(np.float64)
        score = np.zeros((len(self.ids), len(queries)))
        sums, lengths = np.abs(wide).sum(axis=0), np.sqrt((wide**2).sum(axis=0))
        place = len(self.ids) - min(k, len(self.ids))
        longest = max((len(v) for postings, _, _ in self.segments for _, v, _ in postings), default=0)
        buffers = np.empty((2, longest, len(queries)))
        floor = np.broadcast_to(floor, len(queries))
        found: list = [None] * len(queries)
        open_ = np.arange(len(queries))
        for postings, most, left in self.segments:
            held, added = buffers
            for component, vectors, impacts in postings:
                reached, new = held[: len(vectors)], added[: len(vectors)]
                np.take(score, vectors, axis=0, out=reached, mode="clip")
                np.multiply(impacts, wide[component], out=new)
                reached += new
                score[vectors] = reached
            now = np.where(own[open_, None] == self.ids, -np.inf, score.T)
            more = np.minimum(sums[:, None] * most, lengths[:, None] * left) * (1 + 1e-9)
            bar = np.partition(now - more, place, axis=1)[:, place]
            bar = np.maximum(bar, floor[open_])
            possible = (now + more >= bar[:, None]) & np.isfinite(now)
            done = (possible.sum(axis=1) <= max(FEW, 4 * k)) | (most == 0)
            for row in np.flatnonzero(done):
                members = np.flatnonzero(possible[row])
                exact = self.matrix[members] @ queries[open_[row]]
                order = np.lexsort((self.ids[members], -exact))[:k]
                found[open_[row]] = (exact[order], self.ids[members][order])
            if done.all():
                break
            if done.any():
                open_, score, wide = open_[~done], np.ascontiguousarray(score[:, ~done]), wide[:, ~done]
                sums, lengths = sums[~done], lengths[~done]
                buffers = np.empty((2, longest, len(open_)))
        return found


def _matrix(column: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Vectors as rows; a shorter one counts as padded with zeros, a longer one is cut to ``width``."""
    values, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    width = int(sizes.max(initial=0)) if width is None else width
    made, row = np.zeros((len(sizes), width), np.int64), np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    made[row[at < width], at[at < width]] = values[at < width]
    return made


def _shard(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the batches of a shard."""
    shard = pa.Table.from_batches(batches)
    return shard["id"].to_numpy(), _matrix(pa.concat_arrays(shard["impacts"].chunks))


def _search(k: int):
    """Rows sorted by cell, candidates (kind 0) before queries (kind 1), to (query_id, vec_id, score)."""

    def answers(blocks: list[Index], batch: pa.RecordBatch) -> pa.RecordBatch:
        asked = batch["id"].to_numpy()
        queries = _matrix(batch["impacts"], blocks[0].matrix.shape[1])
        none = np.zeros(0, np.int64)
        found = [(none, none)] * len(asked)
        for low in range(0, len(asked), TILE):
            tile = slice(low, low + TILE)
            floor = np.full(len(asked[tile]), -np.inf)  # what earlier blocks have shown to be needed
            for block in blocks:
                for at, (score, ids) in enumerate(block.best(queries[tile], asked[tile], k, floor)):
                    score = np.concatenate([found[low + at][0], score])
                    ids = np.concatenate([found[low + at][1], ids])
                    order = np.lexsort((ids, -score))[:k]
                    found[low + at] = score[order], ids[order]
                    if len(order) == k:
                        floor[at] = score[order[-1]]
        columns = [
            np.repeat(asked, [len(s) for s, _ in found]),
            np.concatenate([i for _, i in found]),
            np.concatenate([s for s, _ in found]),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, blocks = None, [], []
        for batch in batches:
            cells, kinds = batch["cell"].to_numpy(), batch["kind"].to_numpy()
            turns = np.flatnonzero(np.diff(cells) | np.diff(kinds)) + 1
            for low, high in zip([0, *turns], [*turns, len(cells)]):
                if low == high:
                    continue
                if cells[low] != at:
                    at, held, blocks = cells[low], [], []
                rows = batch.slice(low, high - low)
                if kinds[low] == 0:
                    held.append(rows)
                elif held:
                    if not blocks:
                        ids, vectors = _shard(held)
                        blocks = [
                            Index(ids[i : i + BLOCK], vectors[i : i + BLOCK])
                            for i in range(0, len(ids), BLOCK)
                        ]
                        held = held[:1]
                    yield answers(blocks, rows)

    return search


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for every query; fewer rows where there are fewer vectors.

    Rows with a query's id are its own and no candidates of it; repeated rows of a query's id and
    vector are one query, different vectors of one query id share its ranking, and repeated
    candidates count each. A shorter vector counts as padded with zeros. Scores must fit into 53
    bits, else the search fails; an empty table gives no rows.
    """
    # the place, written with the row, deals the copies of a row over the shards
    rows = stage(quantised(vectors).withColumn("place", F.monotonically_increasing_id()), "impacts")
    is_query = F.pmod("id", F.lit(every)) == 0
    sizes = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.size("impacts")).alias("components"),
        F.count_if(is_query).alias("asked"),
        F.max(F.aggregate("impacts", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("length"),
    ).first()
    if (sizes["length"] or 0) >= 2.0**53:
        raise ValueError("scores of these vectors don't fit into 53 bits")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-sizes["asked"] // QUERIES))
    shards = max(
        1,
        -(-sizes["n"] // SHARD),
        -(-(sizes["components"] or 0) // POSTINGS),
        min(-(-parts // groups), sizes["n"] // LEAST),
    )
    every_group, every_shard = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (groups, shards))
    shard = F.pmod(F.xxhash64("place"), F.lit(shards)).cast("int")
    group = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")
    asked = rows.where(is_query).select("id", "impacts").distinct()
    both = rows.select(
        F.lit(0).alias("kind"), shard.alias("shard"), every_group.alias("group"), "id", "impacts"
    ).unionByName(
        asked.select(
            F.lit(1).alias("kind"), group.alias("group"), every_shard.alias("shard"), "id", "impacts"
        )
    )
    cell = (F.col("group") * shards + F.col("shard")).alias("cell")
    met = both.select(cell, "kind", "id", "impacts").repartitionById(min(groups * shards, 4 * parts), "cell")
    found = met.sortWithinPartitions("cell", "kind").mapInArrow(
        _search(k), "query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
with rows as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from rows q, rows c
  where q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
placed as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank
  from scored)
select query_id, rank, vec_id, score from placed where rank <= 5"""
