"""A log of finished parts, so that a long job that was stopped goes on where it ended.

A part is written first and committed afterwards, by one small file that Spark's committer moves into
place. What was written without a commit does not count: it is written again.
"""

from __future__ import annotations

import json
import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError
from .tables import identity

SCHEMA = "part string, record string, at long"
#: The part that holds what a log was begun with.
_BEGUN = "#settings"


class CommitLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        """(part, record, at): the last commit of each part; settings are not among them."""
        return self._all().where(F.col("part") != _BEGUN)

    def _all(self) -> DataFrame:
        try:
            rows = self.spark.read.schema(SCHEMA).json(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy("part").agg(F.max_by("record", "at").alias("record"), F.max("at").alias("at"))

    def begin(self, **settings) -> None:
        """Note what the parts are made with; a log that was begun with other settings is refused."""
        held = [r.record for r in self._all().where(F.col("part") == _BEGUN).collect()]
        if not held:
            self._append({_BEGUN: settings})
        elif json.loads(held[0]) != json.loads(json.dumps(settings)):
            raise InputError(f"{self.path} was begun with {held[0]}, not with {json.dumps(settings, sort_keys=True)}")

    def done(self) -> dict[str, dict]:
        """Record of each finished part. Parts are folders or shards, so few."""
        return {r.part: json.loads(r.record) for r in self.table().collect()}

    def commit(self, parts: dict[str, dict]) -> None:
        self._append(parts)

    def _append(self, parts: dict[str, dict]) -> None:
        rows = [(part, json.dumps(record, sort_keys=True), time.time_ns()) for part, record in parts.items()]
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(self.path)


def mark_of(**facts) -> str:
    """A short name for what a result was made from."""
    return identity(json.dumps(facts, sort_keys=True, default=str))


def digest(*columns: str) -> Column:
    """An aggregate over rows that tells their content, whatever its order and partitions; repeated rows count."""
    # Two exact sums of hashes with different seeds, each cut to 62 bits. Pieces of 21 bits add up as longs, to decimals only at the end.
    def piece(seed: int, i: int) -> Column:
        word = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 2)
        return F.sum(F.shiftright(word, 21 * i).bitwiseAND(F.lit((1 << 21) - 1))).cast("decimal(38,0)") * F.lit(1 << 21 * i).cast("decimal(20,0)")

    sums = [(piece(seed, 0) + piece(seed, 1) + piece(seed, 2)).cast("decimal(38,0)") for seed in (1, 2)]
    return F.sha2(F.concat_ws("/", *sums), 256)


def content(df: DataFrame, *columns: str) -> DataFrame:
    """One row (rows, digest) of a table's content."""
    return df.agg(F.count(F.lit(1)).alias("rows"), digest(*columns).alias("digest"))
