"""Small files beside the tables: query splits, reference subsets, frozen universes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contracts
from ..errors import InputError, UniverseError


def write_split(path: str, split: dict[str, list[str]], seed: int) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"seed": seed, "n_queries": sum(map(len, split.values())), "sizes": {k: len(v) for k, v in split.items()}, "splits": split}, f, indent=1)


def read_split(path: str) -> dict[str, list[str]]:
    """A split, whether nested under ``splits`` or flat."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    return {k: list(v) for k, v in raw.get("splits", raw).items() if isinstance(v, list)}


def check_split(split: dict[str, list[str]], query_ids: list[str]) -> None:
    every = [q for part in split.values() for q in part]
    if any(not part for part in split.values()):
        raise InputError("a part of the split is empty")
    if len(every) != len(set(every)) or set(every) != set(query_ids):
        raise InputError("the split is not a partition of the queries")


def split_table(spark: SparkSession, split: dict[str, list[str]]) -> DataFrame:
    """(query_id, split): small, to be joined by broadcast."""
    return spark.createDataFrame([(q, s) for s, part in split.items() for q in part], "query_id string, split string")


def write_ids(path: str, ids: list[str]) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(f"{i}\n" for i in ids)


def read_ids(path: str) -> list[str]:
    """Ids one a line, or the ``query_ids`` of a JSON manifest."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if text.lstrip().startswith("{"):
        return list(json.loads(text)["query_ids"])
    return [x.strip() for x in text.splitlines() if x.strip()]


def freeze(universe: DataFrame, path: str, fingerprint: str) -> None:
    """Write a universe with the fingerprint of its settings; an existing one is not overwritten."""
    rows = contracts.validate(universe, "universe").withColumn("fingerprint", F.lit(fingerprint))
    rows.write.mode("errorifexists").parquet(path)


def load_frozen(spark: SparkSession, path: str, fingerprint: str | None = None) -> DataFrame:
    """A frozen universe; one of other settings is refused."""
    rows = spark.read.parquet(path)
    marks = [r.fingerprint for r in rows.select("fingerprint").distinct().limit(2).collect()]
    if len(marks) > 1 or fingerprint is not None and marks and marks[0] != fingerprint:
        raise UniverseError(f"the universe at {path} belongs to {marks}, not {fingerprint}")
    return rows.drop("fingerprint")
