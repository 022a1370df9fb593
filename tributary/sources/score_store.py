"""A keyed store of scores (query_id, doc_id, model -> score) as Parquet by model.

Writes append with a version; a read takes each key's latest. That makes repeated and merged writes
idempotent and lets many writers work at once.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError, MissingScoreError
from ..operators.ranking import rank_in_ranges

KEY = ["query_id", "doc_id", "model"]
SCHEMA = "query_id string, doc_id string, score double, version long, model string"


def latest(rows: DataFrame) -> DataFrame:
    """The score of the highest version of each key."""
    return rows.groupBy(*KEY).agg(F.max_by("score", "version").alias("score"))


def missing(universe: DataFrame, scores: DataFrame, model: str) -> DataFrame:
    """Pairs of the universe without a score of ``model``."""
    return universe.select("query_id", "doc_id").join(scores.where(F.col("model") == model).select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")


def coverage(universe: DataFrame, scores: DataFrame, model: str) -> DataFrame:
    """Per query: universe size, scored and missing."""
    own = scores.where(F.col("model") == model).select("query_id", "doc_id", F.lit(1).alias("hit")).distinct()
    got = universe.select("query_id", "doc_id").join(own, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_universe"), F.count("hit").alias("n_scored"))
    return got.withColumn("n_missing", F.col("n_universe") - F.col("n_scored"))


class ScoreStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, rows: DataFrame, version: int | None = None) -> None:
        """Add (query_id, doc_id, model, score); a later version of a key wins, null scores are refused."""
        version = time.time_ns() if version is None else version
        sound = F.when(F.col("score").isNotNull() & ~F.isnan("score"), F.col("score")).otherwise(F.raise_error(F.lit("a score is missing")).cast("double"))
        out = rows.select("query_id", "doc_id", sound.cast("double").alias("score"), F.lit(version).cast("long").alias("version"), "model")
        out.write.mode("append").partitionBy("model").parquet(self.path)

    def scores(self, model: str | None = None) -> DataFrame:
        rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        return latest(rows if model is None else rows.where(F.col("model") == model))

    def versions(self, model: str) -> DataFrame:
        """(query_id, doc_id, score, version) of each key's latest version."""
        rows = self.spark.read.schema(SCHEMA).parquet(self.path).where(F.col("model") == model)
        return rows.groupBy("query_id", "doc_id").agg(F.max_by("score", "version").alias("score"), F.max("version").alias("version"))

    def merge_from(self, other: ScoreStore, model: str) -> None:
        """Take over another store's scores of one model, its versions with them; what is here already is
        not written again. ``shard_merge`` tells where stores disagree."""
        key = ["query_id", "doc_id", "version"]
        rows = self.spark.read.schema(SCHEMA).parquet(other.path).where(F.col("model") == model)
        held = self.spark.read.schema(SCHEMA).parquet(self.path).where(F.col("model") == model).select(*key)
        rows.join(held, key, "left_anti").write.mode("append").partitionBy("model").parquet(self.path)

    def models(self) -> list[str]:
        return sorted(r.model for r in self.scores().select("model").distinct().collect())

    def queries(self, model: str) -> DataFrame:
        """(query_id, n_scores) of the queries that ``model`` has scores of."""
        return self.scores(model).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_scores"))

    def count(self, model: str | None = None) -> int:
        return self.scores(model).count()

    def require_complete(self, universe: DataFrame, model: str) -> None:
        gaps = coverage(universe, self.scores(), model)
        if not gaps.limit(1).count():
            raise InputError("the universe has no queries")
        worst = gaps.where("n_missing > 0").orderBy(F.desc("n_missing"), "query_id").limit(3).collect()
        if worst:
            raise MissingScoreError(f"scores of {model} are missing: {[(r.query_id, r.n_missing) for r in worst]}")

    def fill(self, universe: DataFrame, model: str, score) -> dict[str, int]:
        """Score what is missing with ``score`` (a function of the pairs that adds a score column) and store it.

        The report counts the pairs asked for, those held before and those that the store has now.
        """
        def held() -> int:
            row = coverage(universe, self.scores(), model).agg(F.sum("n_universe").alias("n"), F.sum("n_scored").alias("scored")).first()
            asked.append(row["n"] or 0)
            return row["scored"] or 0

        asked: list[int] = []
        before = held()
        self.put(score(missing(universe, self.scores(), model)).withColumn("model", F.lit(model)))
        after = held()
        return {"asked": asked[-1], "held_before": before, "scored": after - before, "missing": asked[-1] - after}


def _picks(load: list[int], size: int, queries: int) -> list[int]:
    """How many of ``queries`` queries of ``size`` pairs each shard takes, always the least loaded, ties to the first.

    Shard i takes its k-th one at a load of load[i] + k * size, so those below one level are taken, and of
    those at the next level the first shards'.
    """
    def below(level: int) -> list[int]:
        return [max(0, -(-(level - at) // size)) for at in load]

    low, high = min(load), max(load) + size * (queries + 1)
    while high - low > 1:  # the highest level that not more than ``queries`` loads lie below
        mid = (low + high) // 2
        low, high = (mid, high) if sum(below(mid)) <= queries else (low, mid)
    taken = below(low)
    rest = queries - sum(taken)
    for i, at in enumerate(load):
        if rest and low >= at and (low - at) % size == 0:
            taken[i], rest = taken[i] + 1, rest - 1
    return taken


def plan_shards(universe: DataFrame, shards: int = 3, ranges: int = 64) -> DataFrame:
    """(query_id, pairs, shard): queries by falling size, ties by id, each to the least loaded shard.

    Queries of one size are dealt out together: what a shard takes of them follows from the loads before,
    and so does the place of each in the order of that size. The driver sees a row per size, of which there
    are at most as many as a pool is deep; queries find their place by ranges of (size, id).
    """
    if shards < 1:
        raise InputError("a plan has at least one shard")
    spark = universe.sparkSession
    counts = universe.groupBy("query_id").agg(F.count(F.lit(1)).alias("pairs"))
    ranked = rank_in_ranges(counts.select(F.col("pairs").alias("query_id"), F.col("query_id").alias("doc_id"), F.lit(0.0).alias("score")), "score", "place", ranges)
    classes, load = [], [0] * shards
    for row in ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("query_id")).collect():
        size, taken = row.query_id, _picks(load, row.query_id, row.n)
        classes += [(size, i, load, n) for i, n in enumerate(taken) if n]
        load = [at + n * size for at, n in zip(load, taken, strict=True)]
    dealt = spark.createDataFrame(classes, "pairs long, shard int, load array<long>, n long").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    level = F.get("load", "shard") + F.col("k") * F.col("pairs")

    def earlier(at: Column, i: Column) -> Column:
        ahead = F.greatest(F.lit(0).cast("long"), F.ceil((level - at) / F.col("pairs")).cast("long"))
        tie = (i < F.col("shard")) & (level >= at) & (F.pmod(level - at, F.col("pairs")) == 0)
        return ahead + tie.cast("long")

    place = F.aggregate(F.transform("load", earlier), F.lit(1).cast("long"), lambda s, v: s + v)
    placed = dealt.select("pairs", place.alias("place"), "shard")
    own = ranked.select(F.col("doc_id").alias("query_id"), F.col("query_id").alias("pairs"), F.col("place").cast("long").alias("place"))
    return own.join(placed, ["pairs", "place"]).select("query_id", "pairs", "shard")


def shard_loads(plan: DataFrame) -> DataFrame:
    """(shard, n_queries, n_pairs) of a plan."""
    return plan.groupBy("shard").agg(F.count(F.lit(1)).alias("n_queries"), F.sum("pairs").alias("n_pairs"))


def shard_plan(universe: DataFrame, shards: int = 3) -> list[tuple[int, str, int]]:
    """The rows (shard, query_id, pairs) of :func:`plan_shards` in order, for a small plan's file."""
    return sorted((r.shard, r.query_id, r.pairs) for r in plan_shards(universe, shards).collect())
