"""Judgments: attached by left join, so that unjudged never turns into not relevant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["query_id", "doc_id"]


def attach(universe: DataFrame, qrels: DataFrame) -> DataFrame:
    """The universe with relevance (null: unjudged) and judged; judgments outside it are dropped."""
    own = qrels.where(F.coalesce("judged", F.lit(False))).select(*KEY, "relevance", F.lit(True).alias("judged"))
    return universe.join(own, KEY, "left").withColumn("judged", F.coalesce("judged", F.lit(False)))


def coverage(universe: DataFrame, qrels: DataFrame, gain) -> DataFrame:
    """Per query: universe size, judged, with a gain, and the judged share."""
    got = attach(universe, qrels).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_universe"), F.sum(F.col("judged").cast("long")).alias("n_judged"), F.sum((gain(F.col("relevance")) > 0).cast("long")).alias("n_relevant"))
    return got.withColumn("judged_share", F.col("n_judged") / F.col("n_universe"))


def judged_outside(qrels: DataFrame, candidates: DataFrame, gain) -> DataFrame:
    """Per query: judged documents, those outside the candidate set, and those there with a gain."""
    inside = candidates.select(*KEY).distinct().withColumn("inside", F.lit(True))
    rows = qrels.where(F.coalesce("judged", F.lit(False))).join(inside, KEY, "left").withColumn("outside", F.col("inside").isNull())
    return rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_judged"), F.sum(F.col("outside").cast("long")).alias("n_outside"), F.sum((F.col("outside") & (gain(F.col("relevance")) > 0)).cast("long")).alias("n_outside_relevant"))


def density(candidates: DataFrame, qrels: DataFrame, gain, depths: list[int]) -> DataFrame:
    """Per (query, k_c): candidates judged and relevant, and the recall of the relevant ones."""
    ranked = candidates.withColumn("k_c", F.explode(F.array(*map(F.lit, depths)))).where("rank <= k_c")
    own = qrels.where(F.coalesce("judged", F.lit(False))).select(*KEY, "relevance", F.lit(True).alias("is_judged"), (gain(F.col("relevance")) > 0).alias("good"))
    got = ranked.join(own, KEY, "left").groupBy("query_id", "k_c").agg(F.count(F.lit(1)).alias("n_candidates"), F.sum(F.coalesce("is_judged", F.lit(False)).cast("long")).alias("n_judged"), F.sum(F.coalesce("good", F.lit(False)).cast("long")).alias("n_relevant"))
    total = own.groupBy("query_id").agg(F.sum(F.col("good").cast("long")).alias("n_relevant_all"))
    both = got.join(total, "query_id", "left").withColumn("n_relevant_all", F.coalesce("n_relevant_all", F.lit(0).cast("long")))
    return both.withColumn("recall", F.try_divide(F.col("n_relevant").cast("double"), F.col("n_relevant_all").cast("double")))


def unmapped_grades(qrels: DataFrame, grades: list[int]) -> DataFrame:
    """Observed grades without a gain."""
    return qrels.where(F.col("relevance").isNotNull() & ~F.col("relevance").isin(*grades)).groupBy("relevance").agg(F.count(F.lit(1)).alias("n"))
