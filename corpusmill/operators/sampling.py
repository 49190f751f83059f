"""Shuffles, samples and splits that repeat exactly: all draw from a seeded hash of the key."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.constants import SEED, TEST_FRACTION
from corpusmill.functions.hashing import chosen, seeded_md5
from corpusmill.operators.ordering import first_in_hash_order, hash_position

ROUNDS = 40  # of a permutation; each one swaps about half of the pairs that it makes


def epoch_place(position: Column, n: int | Column, epoch: int, seed: int = SEED) -> Column:
    """Where an epoch's order puts the row at the dense ``position`` among ``n``: a permutation of
    0 to n - 1, another one for each seed and epoch, computed from the row's own position.

    A round pairs every place x with (k - x) mod n and swaps a pair or leaves it by a bit drawn from its
    larger member, so it maps places one to one for every n. Nothing is moved or sorted.
    """
    rounds = F.array(
        *[
            F.struct(F.lit(f"{seed}:{epoch}:{r}:").alias("mark"), F.lit(_round_key(seed, epoch, r)).alias("key"))
            for r in range(1, ROUNDS + 1)
        ]
    )
    size = n if isinstance(n, Column) else F.lit(n)

    def swapped(x: Column, step: Column) -> Column:
        other = F.pmod(step["key"] - x, size)
        bit = F.ascii(F.md5(F.concat(step["mark"], F.greatest(x, other).cast("string")))) % 2
        return F.when(bit == 1, other).otherwise(x)

    return F.aggregate(rounds, position.cast("bigint"), swapped)


def _round_key(seed: int, epoch: int, number: int) -> int:
    return int(hashlib.md5(f"{seed}:{epoch}:{number}".encode()).hexdigest()[:12], 16)


def epochs(df: DataFrame, position: str, n: int, count: int, seed: int = SEED) -> DataFrame:
    """Every row once for each of ``count`` epochs, with ``epoch`` and its ``place`` in that epoch's order."""
    places = [
        F.struct(F.lit(e).alias("epoch"), epoch_place(F.col(position), n, e, seed).alias("place"))
        for e in range(count)
    ]
    return df.select("*", F.inline(F.array(*places)))


def shuffle(df: DataFrame, keys: list[str], seed: int = SEED) -> DataFrame:
    """The table in seeded hash order: a range-partitioned sort on evenly spread values."""
    columns = [F.col(k) for k in keys]
    return df.orderBy(seeded_md5(seed, *columns), *columns)


def sample_n(
    df: DataFrame, n: int, keys: list[str], seed: int = SEED, position: str = "position"
) -> DataFrame:
    """The first ``n`` rows of the seeded shuffle, numbered by ``position``.

    Hash buckets that start beyond ``n`` are dropped before the shuffle. A sort with a limit would
    instead send up to ``n`` rows of every input partition to one task.
    """
    return hash_position(df, seed, keys, position, below=F.lit(n))


def percent_sample(
    df: DataFrame, percent: float, keys: list[str], seed: int = SEED
) -> DataFrame:
    """About ``percent`` % of the rows, decided row by row; works on streams."""
    return df.where(chosen(percent / 100, seed, *[F.col(k) for k in keys]))


def split_label(
    keys: list[str], test_fraction: float = TEST_FRACTION, seed: int = SEED
) -> Column:
    """'test' or 'train' per row. A row keeps its side when others are added."""
    drawn = chosen(test_fraction, seed, *[F.col(k) for k in keys])
    return F.when(drawn, F.lit("test")).otherwise(F.lit("train"))


def exact_split(
    df: DataFrame, keys: list[str], test_fraction: float = TEST_FRACTION, seed: int = SEED
) -> DataFrame:
    """As ``split_label`` with exactly ``ceil(n * test_fraction)`` test rows."""
    size = F.ceil(F.col("_total") * F.lit(test_fraction))
    test = first_in_hash_order(df, seed, keys, size)
    return df.withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train")))
