"""Centroid clustering by dimension-sharded Lloyd rounds on whole numbers.

Rows are packed into chunks where they lie, and each chunk is cut into column blocks. In a round, one
task for each (chunk, block) computes the partial squared distances of its columns to its slice of the
centroids; the blocks of a chunk are added up by chunk, which gives each row's nearest centroid; then
each (chunk, block) totals its own columns by centroid, and each block replaces its slice of the
centroids by the exact floors of the means. No task holds more than a chunk, or more columns than a
block, and all sums are of whole numbers, so the result does not depend on how rows were dealt.

What is broadcast is the centroids: k rows of the vectors' width.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import table
from corpusmill.session import stage

SCALE = 64
WIDTH = 64
CENTROIDS = 16
ROUNDS = 3
BLOCK = 16  # columns of a shard
CHUNK = 1024  # rows of a chunk at most
SEED = "1"
LARGEST = 1 << 25  # components are smaller, so that a distance of 1,024 columns fits into 64 bits

SHARDS = "chunk long, block int, n int, ids array<long>, cells binary"


def usable(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, cells): floor(scale x) of the vectors of ``width`` components, none null or non-finite."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("wide", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), wide.alias("wide"))
        .where((F.size("wide") == width) & ~F.coalesce(bad, F.lit(True)))
        .select("vec_id", F.transform("wide", lambda x: F.floor(x * scale).cast("long")).alias("cells"))
    )


def _cut(width: int):
    """Rows into chunks of the partition they lie in, and those into column blocks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                rows = batch.slice(at, CHUNK)
                cells = rows["cells"].flatten().to_numpy().reshape(rows.num_rows, width)
                blocks = [np.ascontiguousarray(cells[:, c : c + BLOCK]) for c in range(0, width, BLOCK)]
                ids = rows["vec_id"].to_pylist()
                yield pa.RecordBatch.from_pydict(
                    {
                        "chunk": pa.array([number] * len(blocks), pa.int64()),
                        "block": pa.array(range(len(blocks)), pa.int32()),
                        "n": pa.array([rows.num_rows] * len(blocks), pa.int32()),
                        "ids": pa.array([ids] + [None] * (len(blocks) - 1), pa.list_(pa.int64())),
                        "cells": pa.array([b.tobytes() for b in blocks], pa.binary()),
                    }
                )
                number += 1

    return cut


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Squared distances of each row's columns to each centroid's, as one matrix for each shard."""
    for batch in batches:
        made = []
        for n, cells, slice_ in zip(batch["n"].to_pylist(), batch["cells"], batch["slice"].to_pylist()):
            mine = np.frombuffer(cells.as_buffer(), np.int64).reshape(n, -1)
            centres = np.array(slice_, np.int64)
            apart = np.empty((n, len(centres)), np.int64)
            for k, centre in enumerate(centres):
                apart[:, k] = ((mine - centre) ** 2).sum(axis=1)
            made.append(apart.tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch["chunk"], batch["n"], batch["ids"], pa.array(made, pa.binary())],
            ["chunk", "n", "ids", "apart"],
        )


def _nearest(group: pa.Table) -> pa.Table:
    """The shards of one chunk added up: each row's centroid and its squared distance."""
    n = group["n"][0].as_py()
    total = sum(np.frombuffer(a.as_buffer(), np.int64).reshape(n, -1) for a in group["apart"])
    cluster = total.argmin(axis=1)  # the first of equal ones
    ids = [x for x in group["ids"].to_pylist() if x is not None]
    return pa.Table.from_pydict(
        {
            "chunk": group["chunk"].slice(0, 1),
            "ids": pa.array(ids, pa.list_(pa.int64())),
            "cluster": pa.array([cluster], pa.list_(pa.int32())),
            "distance": pa.array([total[np.arange(n), cluster]], pa.list_(pa.int64())),
        }
    )


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each shard's columns by centroid, a row for each centroid that has rows in it."""
    for batch in batches:
        blocks, clusters, sums, counts = [], [], [], []
        for block, n, cells, cluster in zip(
            batch["block"].to_pylist(), batch["n"].to_pylist(), batch["cells"], batch["cluster"]
        ):
            mine = np.frombuffer(cells.as_buffer(), np.int64).reshape(n, -1)
            of = cluster.values.to_numpy()
            order = np.argsort(of, kind="stable")
            held, start = np.unique(of[order], return_index=True)
            total = np.add.reduceat(mine[order], start, axis=0)
            blocks += [block] * len(held)
            clusters += held.tolist()
            sums += total.tolist()
            counts += np.diff([*start, n]).tolist()
        yield pa.RecordBatch.from_pydict(
            {
                "block": pa.array(blocks, pa.int32()),
                "cluster": pa.array(clusters, pa.int32()),
                "sums": pa.array(sums, pa.list_(pa.int64())),
                "n": pa.array(counts, pa.int64()),
            }
        )


def _first(rows: DataFrame, k: int, seed: str) -> DataFrame:
    """(cluster, block, slice): the rows of the smallest hashes of their ids."""
    text = F.coalesce(F.col("vec_id").cast("string"), F.lit(""))
    chosen = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), text), 256).alias("hash"), "cells")
    chosen = chosen.orderBy("hash", "cells").limit(k)
    numbered = chosen.withColumn("cluster", F.row_number().over(Window.orderBy("hash", "cells")) - 1)
    parts = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("cells") - 1) / F.lit(BLOCK)).cast("int")),
        lambda b: F.slice("cells", b * BLOCK + 1, F.lit(BLOCK)),
    )
    return numbered.select("cluster", F.posexplode(parts).alias("block", "slice"))


def _assigned(shards: DataFrame, centres: DataFrame, label: str) -> DataFrame:
    """(chunk, ids, cluster, distance) of each chunk, staged."""
    slices = centres.groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("cluster", "slice"))).alias("_slices")
    )
    slices = slices.select("block", F.col("_slices.slice").alias("slice"))
    given = shards.join(F.broadcast(slices), "block").select("chunk", "n", "ids", "cells", "slice")
    apart = given.mapInArrow(_partial, "chunk long, n int, ids array<long>, apart binary")
    made = "chunk long, ids array<long>, cluster array<int>, distance array<long>"
    return stage(apart.groupBy("chunk").applyInArrow(_nearest, made), label)


def _moved(shards: DataFrame, assigned: DataFrame, centres: DataFrame, label: str) -> DataFrame:
    """The centroids after a round: exact floors of the means, an empty one as it was; staged."""
    given = shards.drop("ids").join(assigned.select("chunk", "cluster"), "chunk")
    totals = given.select("block", "n", "cells", "cluster").mapInArrow(
        _totals, "block int, cluster int, sums array<long>, n long"
    )
    long = totals.select("block", "cluster", "n", F.posexplode("sums").alias("place", "total"))
    means = long.groupBy("block", "cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    floor = F.expr("(total - pmod(total, n)) div n")
    made = means.groupBy("block", "cluster").agg(
        F.sort_array(F.collect_list(F.struct("place", floor.alias("mean")))).alias("_means")
    )
    made = made.select("block", "cluster", F.col("_means.mean").alias("_mean"))
    kept = centres.join(made, ["block", "cluster"], "left")
    return stage(kept.select("cluster", "block", F.coalesce("_mean", "slice").alias("slice")), label)


def cluster(
    rows: DataFrame, width: int = WIDTH, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each row of ``rows``
    (vec_id, cells), whose vectors all have ``width`` whole numbers.

    The first centroids are the ``k`` rows with the smallest sha256 of ``seed:vec_id``, ties by the
    cells; a null id counts as empty text. With fewer rows there are fewer centroids. Repeated rows
    count each. An empty table gives no rows. Components of 2^25 or more fail, as do
    sums that don't fit into 64 bits.
    """
    rows = stage(rows.select("vec_id", "cells"), "cells")
    most = rows.agg(F.max(F.greatest(F.array_max("cells"), -F.array_min("cells"))).alias("most")).first()["most"]
    if most is not None and most >= LARGEST:
        raise ValueError(f"components must be smaller than {LARGEST}")
    shards = stage(rows.mapInArrow(_cut(width), SHARDS), "shards")
    centres = stage(_first(rows, k, seed), "centroids-0")
    assigned = _assigned(shards, centres, "assigned-0")
    for number in range(1, rounds + 1):
        centres = _moved(shards, assigned, centres, f"centroids-{number}")
        assigned = _assigned(shards, centres, f"assigned-{number}")

    long = assigned.select(F.inline(F.arrays_zip(F.col("ids").alias("vec_id"), "cluster", "distance")))
    sums = long.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    every = Window.partitionBy(F.lit(0))
    sums = sums.withColumn("inertia", F.sum("cluster_inertia").over(every))  # k rows
    known = sums.join(F.broadcast(_digests(centres)), "cluster")
    return long.join(F.broadcast(known), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _digests(centres: DataFrame) -> DataFrame:
    whole = centres.groupBy("cluster").agg(
        F.sort_array(F.collect_list(F.struct("block", "slice"))).alias("_slices")
    )
    return whole.select("cluster", F.sha2(_comma_joined(F.flatten("_slices.slice")), 256).alias("centroid_sha256"))


def _comma_joined(numbers: Column) -> Column:
    return F.array_join(numbers.cast("array<string>"), ",")


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(usable(table(spark, sf_dir, "embeddings")))


def _assign_sql(number: int) -> str:
    return f"""near_{number} as (
  select r, vec_id, v, cluster, distance from (
    select r, vec_id, v, c.cluster,
           list_sum(list_transform(list_zip(v, c.centre), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as distance
    from kept, centres_{number} c)
  qualify row_number() over (partition by r order by distance, cluster) = 1)"""


def _move_sql(number: int) -> str:
    return f"""means_{number} as (
  select cluster, list(mean order by place) as centre from (
    select cluster, place, ((total - ((total % n) + n) % n) // n)::bigint as mean from (
      select cluster, place, sum(x)::bigint as total, count(*) as n from (
        select cluster, unnest(v) as x, generate_subscripts(v, 1) as place from near_{number - 1})
      group by cluster, place))
  group by cluster),
centres_{number} as (
  select c.cluster, coalesce(m.centre, c.centre) as centre
  from centres_{number - 1} c left join means_{number} m using (cluster))"""


_STEPS = ",\n".join([_assign_sql(0)] + [f"{_move_sql(i)},\n{_assign_sql(i)}" for i in range(1, ROUNDS + 1)])

SQL = f"""
with kept as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v
  from embeddings
  where len(embedding) = {WIDTH} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
centres_0 as (
  select row_number() over (order by hash, v) - 1 as cluster, v as centre from (
    select sha256('{SEED}:' || coalesce(vec_id::varchar, '')) as hash, v from kept)
  qualify cluster < {CENTROIDS}),
{_STEPS}
select vec_id, n.cluster::int as cluster, distance,
       sum(distance) over (partition by n.cluster)::bigint as cluster_inertia,
       sum(distance) over ()::bigint as inertia,
       sha256(array_to_string(c.centre, ',')) as centroid_sha256
from near_{ROUNDS} n join centres_{ROUNDS} c on n.cluster = c.cluster"""
