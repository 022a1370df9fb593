"""Findings over effect tables: fidelity within strata, intervals, mechanism checks, cost curves."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import names as N
from ..errors import InputError
from ..functions import statistics as S
from ..functions.special import binomial_p
from ..functions.utility import Utility
from ..operators import allocation, effects, features, probes, resample, summaries, synthetic, worlds
from ..sources.tables import scratch


def fidelity_within_strata(frame: DataFrame, predicted: str, top_m: int = 20, draws: int = 200, least: int = 30, seed: int = 42) -> DataFrame:
    """Metrics of one predictor per (effect type, stratum), never pooled, with intervals over queries.

    Intervals of mae, rmse, the rank correlation and top-m recovery share their draws, which are weights
    by hash (:mod:`..operators.resample`). Strata that are zero by construction get counts and mean
    errors only.
    """
    keys = ["effect_type", "stratum"]
    place = scratch(frame.sparkSession, "predicted")  # points, heads and sums read the rows
    frame.where(F.coalesce("judged", F.lit(False))).select(*keys, "query_id", "doc_id", F.col(predicted).cast("double").alias("p"), "effect").write.parquet(place)
    rows, predicted = frame.sparkSession.read.parquet(place), "p"
    points = S.point_metrics(rows, predicted, "effect", keys)
    best = S.top_m_recovery(rows, predicted, "effect", keys, top_m, ["query_id", "doc_id"]).select(*keys, "top_m_recovery")
    sums = resample.rank_sums(rows, predicted, "effect", keys)
    each = resample.replicate_intervals(sums, keys, resample.FIDELITY, resample.RANK_SUMS, draws, seed=seed)
    each = each.unionByName(resample.top_m_intervals(rows, predicted, "effect", keys, top_m, ["query_id", "doc_id"], draws, seed=seed))
    wide = each.groupBy(*keys).agg(*[F.max(F.when(F.col("statistic") == s, F.col(side))).alias(f"{s}_{side}") for s in INTERVALS for side in ("lo", "hi")])
    queries = sums.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_queries"))
    zero = F.coalesce(*[F.when(F.col("effect_type") == k, F.col("stratum").isin(*v) if v else F.lit(False)) for k, v in N.STRUCTURAL_ZERO.items()], F.lit(False))
    out = points.join(best, keys, "left").join(wide, keys, "left").join(queries, keys, "left").withColumn("structural_zero", zero).withColumn("underpowered", F.col("n") < least)
    informative = ["pearson", "spearman", "top_m_recovery", "rmse", *(f"{s}_{side}" for s in INTERVALS[1:] for side in ("lo", "hi"))]
    return out.withColumns({c: F.when(~F.col("structural_zero"), F.col(c)) for c in informative})


#: Statistics that :func:`fidelity_within_strata` gives intervals of.
INTERVALS = ["mae", "rmse", "spearman", "top_m_recovery"]


def paired_intervals(first: DataFrame, second: DataFrame, draws: int = 1000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Intervals of per-query differences between two systems' diagnoses, on shared resamples."""
    cols = ["dcg_actual", "g_q", "r_q"]
    both = first.select("query_id", *[F.col(c).alias(f"a_{c}") for c in cols]).join(second.select("query_id", *[F.col(c).alias(f"b_{c}") for c in cols]), "query_id")
    diff = both.select("query_id", F.lit("all").alias("scope"), F.lit(1.0).alias("n"), *[(F.col(f"a_{c}") - F.col(f"b_{c}")).alias(c) for c in cols])
    return resample.replicate_intervals(diff, ["scope"], {c: resample.weighted_mean(c, "n") for c in cols}, ["n", *cols], draws, alpha, seed).drop("scope")


def contrast(first: DataFrame, second: DataFrame, which: str = N.GATE_SENSITIVE) -> dict:
    """Discordant label counts of two systems and their exact test."""
    row = summaries.paired_labels(first, second, which).first().asDict()
    n = row["only_a"] + row["only_b"]
    return row | {"p_one_sided": binomial_p(row["only_a"], n), "p_two_sided": binomial_p(row["only_a"], n, two_sided=True)}


def fit_by_stratum(frame: DataFrame, columns: dict[str, list[str]], train: str, kind: str = "ridge") -> DataFrame:
    """One model per stratum on the judged rows that satisfy ``train``; strata without features predict 0."""
    out = None
    for stratum, names in columns.items():
        own = frame.where(F.col("stratum") == stratum)
        part = features.fit_predict(own.where(f"({train}) and judged"), own.where(f"not ({train})"), names, kind)
        out = part if out is None else out.unionByName(part)
    rest = frame.where(f"not ({train})").where(~F.col("stratum").isin(*columns)).withColumn("prediction", F.lit(0.0))
    return rest if out is None else out.unionByName(rest)


def fit_all_strata(frame: DataFrame, columns: dict[str, list[str]], train: str, alpha: float = 1.0) -> DataFrame:
    """Ridge predictions of every (effect type, stratum) from one aggregate over the judged training rows.

    ``columns`` names the features of each stratum; other strata and those that are zero by construction
    predict 0. A row that lacks one of its features has no prediction. ``frame`` has the features beside
    the effects; rows that satisfy ``train`` are left out of the result.
    """
    keys = ["effect_type", "stratum"]
    every = list(dict.fromkeys(c for names in columns.values() for c in names))
    zero = F.coalesce(*[F.when(F.col("effect_type") == k, F.col("stratum").isin(*v) if v else F.lit(False)) for k, v in N.STRUCTURAL_ZERO.items()], F.lit(False))
    # A feature that is not of the stratum is constant there, so it gets no weight.
    own = {c: F.when(F.col("stratum").isin(*[s for s, names in columns.items() if c in names]), F.col(c)).otherwise(0.0) for c in every}
    rows = frame.withColumns({f"_{c}": x for c, x in own.items()})
    models = features.solve(features.gram(rows.where(f"({train}) and judged").where(~zero & F.col("stratum").isin(*columns)), keys, [f"_{c}" for c in every]), keys, [f"_{c}" for c in every], alpha)
    test = features.predict(rows.where(f"not ({train})"), models, keys, [f"_{c}" for c in every]).drop(*own, *[f"_{c}" for c in every])
    return test.withColumn("prediction", F.when(zero | ~F.col("stratum").isin(*columns), 0.0).otherwise(F.col("prediction")))


def cost_fidelity(built: DataFrame, diagnosis: DataFrame, stage: DataFrame, utility: Utility, budgets: Sequence[int], policies: Sequence[str] = (N.BOUNDARY, N.ALTERNATIVE)) -> DataFrame:
    """Per (policy, budget): calls, error of the approximate gate cost, failures found."""
    out = None
    for p in policies:
        probed = probes.probe(built, budgets, p, utility)
        part = probes.query_fidelity(probed, diagnosis).join(probes.failures_found(probed, effects.gating_failures(stage, N.FINE_EPS)), "budget", "left").withColumn("policy", F.lit(p))
        out = part if out is None else out.unionByName(part)
    return out


def baseline_report(frame: DataFrame, predictions: dict[str, str], target: str = "effect") -> DataFrame:
    """Errors of each named prediction column within each stratum, in one pass over the rows."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("baseline"), F.col(c).cast("double").alias("p")) for n, c in predictions.items()]))
    rows = frame.select("stratum", F.col(target).cast("double").alias("x"), each.alias("b")).select("stratum", "x", "b.*").where("p is not null and x is not null")
    error = F.col("p") - F.col("x")
    return rows.groupBy("baseline", "stratum").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(error).alias("signed_bias"))


def budget_stratum_report(budget: DataFrame) -> DataFrame:
    """Per (policy, t, stratum): documents, mean effect, and how many gained or lost."""
    e = F.col("effect")
    return budget.groupBy("policy", "t", "stratum").agg(F.count(F.lit(1)).alias("n"), F.avg(e).alias("mean"), F.sum((e > N.EPS).cast("long")).alias("n_gained"), F.sum((e < -N.EPS).cast("long")).alias("n_lost"))


def convergence(curve: DataFrame, error: str, tolerance: float | None = None) -> DataFrame:
    """(budget, error, change) along a cost curve of one row a budget; with ``tolerance`` an error at
    the largest budget beyond it is refused."""
    if tolerance is not None:
        last = curve.orderBy(F.desc("budget")).first()
        if last is None or not abs(last[error]) <= tolerance:
            raise InputError(f"{error} is {last and last[error]} at the full budget, not within {tolerance}")
    step = F.col(error) - F.lag(error).over(Window.orderBy("budget"))  # a row for each budget of the settings
    return curve.select("budget", error, step.alias("change"))


def simulate_pool(spark: SparkSession, regime: synthetic.Regime, n_queries: int, n_docs: int, k_c: int, t: float, policy: str, utility: Utility, planted: int = 0, seed: int = 42, tau: float = 0.05) -> DataFrame:
    """(query_id, label, g_q, delta_dcg) of synthetic queries, for power calculations."""
    cascade = synthetic.generate(spark, regime, n_queries, n_docs, seed)
    cascade = synthetic.gate_stress(cascade, k_c, planted) if planted else cascade
    own = worlds.build_worlds(cascade, [k_c])
    spent = allocation.allocate(own, allocation.parameters(spark, [k_c], [1.0, t], [policy]))
    gains = summaries.budget_outcomes(effects.budget_effects(spent, utility)).select("query_id", "delta_dcg")
    return summaries.diagnose(effects.stage_effects(own, utility), tau).select("query_id", "label", "g_q").join(gains, "query_id")


def smallest_sufficient(power: DataFrame) -> int | None:
    row = power.where("meets_target").agg(F.min("size").alias("size")).first()
    return row["size"]


def directional_checks(spark: SparkSession, n_queries: int = 20, n_docs: int = 200, k_c: int = 20, utility: Utility | None = None, seed: int = 42) -> pd.DataFrame:
    """Do effects move as the mechanism that was built in says? One row per declared check."""
    u = utility or Utility("dcg", 10)

    def means(regime: synthetic.Regime, stress=None) -> dict[str, float]:
        c = synthetic.generate(spark, regime, n_queries, n_docs, seed)
        d = summaries.diagnose(effects.stage_effects(worlds.build_worlds(stress(c) if stress else c, [k_c]), u))
        return d.agg(F.avg("g_q").alias("g_q"), F.avg("rerank_signed").alias("rerank"), F.avg("dcg_actual").alias("dcg")).first().asDict()

    strong = synthetic.Regime(0.8, 0.9, 0.2, 0.2)
    base = means(strong)
    weak_gate, weak_rerank = means(synthetic.Regime(0.2, 0.9, 1.0, 0.2)), means(synthetic.Regime(0.8, 0.1, 0.2, 1.5))
    planted = means(strong, lambda c: synthetic.gate_stress(c, k_c, 10))
    checks = [
        ("a weak gate costs more", weak_gate["g_q"] > base["g_q"]),
        ("a weak reranker helps less", weak_rerank["rerank"] < base["rerank"]),
        ("a weak reranker lowers the result", weak_rerank["dcg"] < base["dcg"]),
        ("documents planted below the gate are lost", planted["g_q"] > base["g_q"]),
    ]
    return pd.DataFrame(checks, columns=["check", "holds"])
