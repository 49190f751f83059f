"""Recipes: YAML or JSON files, or plain dicts, that say which tables a job reads and how.

One vocabulary throughout: ``name`` is the dataset, ``path`` where its table lies, ``config`` and
``split`` the part to read, ``subset`` what the part is called in the output. ``rename`` renames
columns and ``source_map`` maps source values to subsets. ``weight`` repeats or thins out an entry's
rows, and ``use`` says which set of questions an entry belongs to.
"""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from corpusmill.functions.constants import SEED
from corpusmill.operators.mixture import weighted_mix
from corpusmill.sources.tables import scan_saved, scan_split

KNOWN = {
    "name",
    "path",
    "config",
    "split",
    "subset",
    "rename",
    "columns",
    "source_map",
    "exclude",
    "samples",
    "layout",
    "weight",
    "use",
}


def load_recipe(path: str) -> dict[str, Any]:
    text = Path(path).read_text()
    if Path(path).suffix in (".yml", ".yaml"):
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("YAML recipes need PyYAML; use a JSON recipe instead") from error
        recipe = yaml.safe_load(text)
    else:
        recipe = json.loads(text)
    return checked(recipe)


def checked(recipe: dict[str, Any]) -> dict[str, Any]:
    """A misspelt key fails here, not by being ignored."""
    for entry in recipe.get("datasets", []):
        unknown = set(entry) - KNOWN
        if unknown:
            raise ValueError(f"unknown keys {sorted(unknown)} in recipe entry {entry.get('name')}")
    return recipe


def open_entry(spark: SparkSession, entry: dict[str, Any]) -> DataFrame:
    """The table of one entry: a split table by default, or a plain saved one."""
    if entry.get("layout", "split") == "plain":
        return scan_saved(spark, entry["path"])
    return scan_split(spark, entry["path"], entry.get("config"), entry.get("split", "train"))


def weighed(df: DataFrame, recipe: dict[str, Any], keys: list[str]) -> DataFrame:
    """Rows of ``df`` (with ``config``) in the proportions of the entries' ``weight``, 1 by default.

    Without any weight the table is returned as it is.
    """
    weights: dict[str, float] = {}
    for entry in recipe["datasets"]:
        weights[entry.get("subset", entry["name"])] = float(entry.get("weight", 1.0))
    if all(w == 1.0 for w in weights.values()):
        return df
    return weighted_mix(df, weights, keys, recipe.get("seed", SEED), "config").drop("copy")
