"""Synthetic cascades with known mechanisms, to see an effect where it was put and nowhere else."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Regime:
    """How strongly each stage's score follows relevance (a) and how noisy it is (sigma)."""

    a1: float
    a2: float
    sigma1: float
    sigma2: float
    quantiles: tuple[float, ...] = (0.80, 0.93, 0.98)

    def __post_init__(self):
        if not (0 <= self.a1 <= 1 and 0 <= self.a2 <= 1) or min(self.sigma1, self.sigma2) < 0:
            raise ValueError("a has to lie in [0, 1] and sigma must not be negative")
        if list(self.quantiles) != sorted(self.quantiles) or not all(0 < q < 1 for q in self.quantiles):
            raise ValueError("quantiles have to rise within (0, 1)")


def generate(spark: SparkSession, regime: Regime, n_queries: int, n_docs: int, seed: int = 42) -> DataFrame:
    """A cascade of n_queries x n_docs; every query has its own random stream, so tasks are independent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in pdf["id"]:
                y, z, w, e1, e2, alt = np.random.default_rng([seed, int(i)]).standard_normal((6, n_docs))
                f1 = regime.a1 * y + np.sqrt(1 - regime.a1**2) * z
                f2 = regime.a2 * y + np.sqrt(1 - regime.a2**2) * w
                yield pd.DataFrame({"query_id": f"sq{i:04d}", "doc_id": [f"sd{j:06d}" for j in range(n_docs)], "y": y, "s1": f1 + regime.sigma1 * e1, "s2": f2 + regime.sigma2 * e2, "alt": 0.6 * y + 0.3 * alt})

    rows = spark.range(n_queries).mapInPandas(run, "query_id string, doc_id string, y double, s1 double, s2 double, alt double")
    grade = F.lit(0)
    for level, q in enumerate(regime.quantiles, start=1):
        grade = F.when(F.col("y") >= NormalDist().inv_cdf(q), level).otherwise(grade)
    order = Window.partitionBy("query_id").orderBy(F.desc("alt"), "doc_id")
    return rows.withColumn("relevance", grade).select("query_id", "doc_id", "s1", "s2", F.row_number().over(order).alias("alt_rank"), "relevance", F.lit(True).alias("judged"))


def gate_stress(cascade: DataFrame, k_c: int, planted: int) -> DataFrame:
    """Push up to ``planted`` relevant candidates of each query just below the gate."""
    q = Window.partitionBy("query_id")
    ranked = cascade.withColumn("r", F.row_number().over(q.orderBy(F.desc("s1"), "doc_id")))
    relevant = (F.col("r") <= k_c) & (F.col("relevance") > 0)
    out = ranked.withColumn("cut", F.min(F.when(F.col("r") <= k_c, F.col("s1"))).over(q)).withColumn("n", F.when(relevant, F.row_number().over(Window.partitionBy("query_id", relevant).orderBy("r"))))
    return out.withColumn("s1", F.when(F.col("n") <= planted, F.col("cut") - 1e-6 * F.col("n")).otherwise(F.col("s1"))).drop("r", "cut", "n")


def budget_stress(cascade: DataFrame, k_c: int, outsiders: int) -> DataFrame:
    """Lift s2 of the first ``outsiders`` documents below the gate above every candidate's."""
    q = Window.partitionBy("query_id")
    ranked = cascade.withColumn("r", F.row_number().over(q.orderBy(F.desc("s1"), "doc_id"))).withColumn("top", F.max(F.when(F.col("r") <= k_c, F.col("s2"))).over(q))
    lifted = F.col("r").between(k_c + 1, k_c + outsiders)
    return ranked.withColumn("s2", F.when(lifted, F.col("top") + 1 - 1e-3 * (F.col("r") - k_c)).otherwise(F.col("s2"))).drop("r", "top")
