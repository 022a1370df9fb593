"""Utility of a document at a rank, as column expressions.

Discounts come from Python's ``math.log2`` as a literal array, so every engine sees the same
doubles; the lookup stays inside generated code.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Gain of each relevance grade.
GAINS = {0: 0.0, 1: 0.0, 2: 3.0, 3: 7.0}
KINDS = ("dcg", "topk", "rbp")


@dataclass(frozen=True)
class Utility:
    """What a document earns at a rank: discounted gain, presence in the top k, or rank-biased precision."""

    kind: str = "dcg"
    k: int = 10
    persistence: float = 0.8
    gains: Mapping[int, float] = field(default_factory=lambda: dict(GAINS))

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown utility {self.kind!r}, expected one of {KINDS}")
        if self.k < 1 or not 0 < self.persistence < 1:
            raise ValueError("k has to be positive and persistence between 0 and 1")

    @property
    def monotone(self) -> bool:
        """Whether the sign rules of effects hold: gains never fall with the grade."""
        by_grade = [self.gains[g] for g in sorted(self.gains)]
        return by_grade == sorted(by_grade) and min(by_grade, default=0) >= 0

    def __str__(self) -> str:
        return f"rbp@{self.k}(p={self.persistence:g})" if self.kind == "rbp" else f"{self.kind}@{self.k}"

    def gain(self, relevance: Column) -> Column:
        """Gain of a grade; null (unjudged) earns 0, a grade without a gain is an error."""
        found = F.lit(None).cast("double")
        for grade in sorted(self.gains, reverse=True):
            found = F.when(relevance == grade, F.lit(float(self.gains[grade]))).otherwise(found)
        refused = F.raise_error(F.concat(F.lit("no gain for grade "), relevance.cast("string"))).cast("double")
        return F.when(relevance.isNull(), F.lit(0.0)).otherwise(F.coalesce(found, refused))

    def discounts(self) -> list[float]:
        if self.kind == "dcg":
            return [1 / math.log2(1 + r) for r in range(1, self.k + 1)]
        if self.kind == "rbp":
            return [(1 - self.persistence) * self.persistence ** (r - 1) for r in range(1, self.k + 1)]
        return [1.0] * self.k

    def of(self, rank: Column, relevance: Column) -> Column:
        """Utility at ``rank``; absent (null) and beyond k is 0."""
        gain = self.gain(relevance)
        worth = F.when(gain > 0, F.lit(1.0)).otherwise(F.lit(0.0)) if self.kind == "topk" else gain * F.get(F.array(*map(F.lit, self.discounts())), rank.cast("int") - 1)
        return F.when(rank.between(1, self.k), worth).otherwise(F.lit(0.0))


def ideal_dcg(judged: DataFrame, k: int, gain: Column) -> DataFrame:
    """(query_id, ideal) of the best possible order of the judged documents."""
    top = judged.where("relevance is not null").withColumn("g", gain)
    order = Window.partitionBy("query_id").orderBy(F.desc("g"), "doc_id")
    ranked = top.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    discount = F.array(*[F.lit(1 / math.log2(1 + r)) for r in range(1, k + 1)])
    return ranked.groupBy("query_id").agg(F.sum(F.col("g") * F.get(discount, F.col("r") - 1)).alias("ideal"))


def ndcg(ranked: DataFrame, judgments: DataFrame, k: int, gain=lambda grade: grade.cast("double")) -> DataFrame:
    """(query_id, dcg, ideal, ndcg) of ``ranked(query_id, doc_id, rank)``.

    ``gain`` maps a grade column: the grade itself by default (the trec_eval convention). Unjudged
    documents earn 0, the ideal covers all judged ones, and a query without gain has ndcg 0.
    """
    discount = F.array(*[F.lit(1 / math.log2(1 + r)) for r in range(1, k + 1)])
    top = ranked.where(F.col("rank") <= k).join(judgments.select("query_id", "doc_id", "relevance"), ["query_id", "doc_id"], "left")
    worth = F.coalesce(gain(F.col("relevance")), F.lit(0.0)) * F.get(discount, F.col("rank") - 1)
    got = top.groupBy("query_id").agg(F.sum(worth).alias("dcg"))
    best = ideal_dcg(judgments, k, gain(F.col("relevance")))
    both = best.join(got, "query_id", "left").withColumn("dcg", F.coalesce("dcg", F.lit(0.0)))
    return both.select("query_id", "dcg", "ideal", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def recall(ranked: DataFrame, judgments: DataFrame, k: int, least_grade: int = 2) -> DataFrame:
    """(query_id, relevant, found, recall) with grade ``least_grade`` or more; null without any."""
    good = judgments.where(F.col("relevance") >= least_grade).select("query_id", "doc_id")
    all_ = judgments.select("query_id").distinct().join(good.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant")), "query_id", "left")
    hit = ranked.where(F.col("rank") <= k).join(good, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    zero = F.lit(0).cast("long")
    both = all_.join(hit, "query_id", "left").select("query_id", F.coalesce("relevant", zero).alias("relevant"), F.coalesce("found", zero).alias("found"))
    return both.withColumn("recall", F.try_divide(F.col("found").cast("double"), F.col("relevant").cast("double")))


def aggregation_gaps(ranked: DataFrame, utility: Utility) -> DataFrame:
    """(query_id, total, dcg, gap): do utilities of documents add up to the ranking's DCG?

    ``ranked(query_id, doc_id, rank, relevance)``. The total sums documents one by one; the DCG is worked
    out from the ranking's first k grades in order, so the two share no lookup by rank.
    """
    total = F.sum(utility.of(F.col("rank"), F.col("relevance")))
    head = F.array_sort(F.collect_list(F.when(F.col("rank") <= utility.k, F.struct("rank", utility.gain(F.col("relevance")).alias("gain")))))
    got = ranked.groupBy("query_id").agg(total.alias("total"), head.alias("head"))
    dcg = F.aggregate("head", F.lit(0.0), lambda s, x: s + x["gain"] / F.log2(x["rank"].cast("double") + 1))
    return got.select("query_id", "total", dcg.alias("dcg")).withColumn("gap", F.abs(F.col("total") - F.col("dcg")))
