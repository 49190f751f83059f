"""Tables that are published one config at a time.

A release lists which run's files hold each config. Publishing writes a new run beside the others and
then adds a release that takes its configs from it, in one atomic rename; so readers see the table
before or after, an interrupted run is in no release, and the files of other configs are not touched.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources.sinks import ALL, write_splits

RUN = "run"


class ReleaseConflict(RuntimeError):
    """Another writer published in the meantime: nothing was changed, publish again."""


def publish(df: DataFrame, path: str, drop: tuple[str, ...] = ()) -> int:
    """Write ``df`` (with ``config`` and ``split``), replace its configs in the table at ``path``, leave
    out those in ``drop``, and return the new release's number, counting from 1.

    Configs that are not in ``df`` stay as they are. A row without a config is an error, found before
    anything is released.
    """
    spark = df.sparkSession
    number, current = release(spark, path)
    run = uuid.uuid4().hex
    write_splits(df, f"{path}/runs/{RUN}={run}")
    written = spark.read.schema(df.schema).parquet(f"{path}/runs/{RUN}={run}")
    configs = [r["config"] for r in written.select("config").distinct().collect()]
    if None in configs:
        raise ValueError("rows without a config can't be published")
    listed = {c: r for c, r in current.items() if c not in drop} | {c: run for c in configs}
    _commit(spark, path, number + 1, listed)
    return number + 1


def release(spark: SparkSession, path: str, number: int | None = None) -> tuple[int, dict[str, str]]:
    """The number of a release, the last one by default, and the run that holds each of its configs.

    0 and no configs where nothing was published. There is one entry for each config of the recipe.
    """
    if number is None:
        number = max(_numbers(spark, path), default=0)
    if number == 0:
        return 0, {}
    lines = spark.read.schema("config string, run string").json(_manifest(path, number))
    return number, {r["config"]: r["run"] for r in lines.collect() if r["config"] is not None}


def scan_release(
    spark: SparkSession,
    path: str,
    config: str = ALL,
    split: str | None = "train",
    number: int | None = None,
) -> DataFrame:
    """One config of a release, or all of them under the config ``all``; other runs' and other
    splits' files are not read."""
    number, listed = release(spark, path, number)
    if not listed:
        raise ValueError(f"nothing is published at {path}")
    runs = sorted(set(listed.values()))
    table = spark.read.option("basePath", f"{path}/runs").parquet(*[f"{path}/runs/{RUN}={r}" for r in runs])
    wanted = {c: r for c, r in listed.items() if config in (ALL, c)}
    held = [(F.col(RUN) == r) & F.col("config").isin([c for c in wanted if wanted[c] == r]) for r in set(wanted.values())]
    table = table.where(reduce(or_, held, F.lit(False))).drop(RUN)
    if split is not None:
        table = table.where(F.col("split") == split)
    return table.withColumn("config", F.lit(ALL)) if config == ALL else table


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete the runs that none of the last ``keep`` releases lists, interrupted ones included; returns
    their names. Not while another writer publishes."""
    numbers = sorted(_numbers(spark, path))[-keep:]
    needed = {r for n in numbers for r in release(spark, path, n)[1].values()}
    fs, folder = _file_system(spark, f"{path}/runs")
    gone = []
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        name = status.getPath().getName().removeprefix(f"{RUN}=")
        if name not in needed:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def _manifest(path: str, number: int) -> str:
    return f"{path}/releases/{number:010d}.json"


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, folder = _file_system(spark, f"{path}/releases")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return [int(n[:10]) for n in names if n.endswith(".json") and n[:10].isdigit()]


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _commit(spark: SparkSession, path: str, number: int, listed: dict[str, str]) -> None:
    """Write the release under another name and rename it, which fails if the name is taken."""
    text = "".join(json.dumps({"config": c, "run": r}) + "\n" for c, r in sorted(listed.items()))
    fs, draft = _file_system(spark, f"{path}/releases/_{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    jvm, final = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(_manifest(path, number))
    rename = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(final), rename)
    except Exception as error:
        fs.delete(draft, False)
        if fs.exists(final):
            raise ReleaseConflict(f"release {number} of {path} is taken") from error
        raise


