"""Aggregates over effect tables: strata, distributions, diagnoses, budget outcomes, promotions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import names as N
from ..functions import statistics as S
from .effects import gating_failures

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def strata_sizes(effects: DataFrame) -> DataFrame:
    return effects.groupBy("effect_type", "stratum").agg(
        F.count(F.lit(1)).alias("n_documents"), F.countDistinct("query_id").alias("n_queries"), F.sum(F.coalesce("judged", F.lit(False)).cast("long")).alias("n_judged"),
        F.avg("effect").alias("mean_effect"), F.avg(F.abs("effect")).alias("mean_abs_effect"),
    )


def thin_strata(effects: DataFrame, least: int = 30) -> DataFrame:
    return strata_sizes(effects).where(F.col("n_documents") < least)


def effect_summary(effects: DataFrame) -> DataFrame:
    """Counts and magnitudes per setting and stratum; null keys (no t, no policy) stay groups."""
    keys = ["effect_type", "stage1_system", "k_c", "utility", "condensed", "t", "policy", "stratum"]
    return effects.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("judged", F.lit(False)).cast("long")).alias("n_judged"),
        F.avg("effect").alias("mean"), F.avg(F.abs("effect")).alias("mean_abs"), F.max(F.abs("effect")).alias("max_abs"),
    )


def distributions(effects: DataFrame, judged_only: bool = False) -> DataFrame:
    """Counts, mean, spread and quantiles of effects per setting and stratum. A stratum may be of any size:
    its quantiles come from counts by value that are dealt out by range."""
    rows = effects.where("judged") if judged_only else effects
    keys = ["condensed", "effect_type", "k_c", "t", "policy", "stratum"]
    rows = S.written(rows.select(*keys, "query_id", "effect"), "effects")
    got = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("query_id").alias("n_queries"), F.avg("effect").alias("mean"), F.stddev_samp("effect").alias("sd"),
        F.avg((F.abs("effect") > N.EPS).cast("double")).alias("share_nonzero"),
    )
    shares = {f"q{int(q * 100):02d}": q for q in QUANTILES}
    got = S.matched(got, S.quantiles(rows, "effect", shares, keys), keys, "left")
    return got.select(*keys, F.lit(judged_only).alias("judged_only"), "n", "n_queries", "mean", "sd", "share_nonzero", *shares)


def macro_average(per_stratum: DataFrame, values: list[str], weight: str | None = None) -> DataFrame:
    """Means over the informative strata of each effect type; NaN and null cells are left out."""
    informative = F.coalesce(*[F.when(F.col("effect_type") == k, F.col("stratum").isin(*v)) for k, v in N.INFORMATIVE.items()], F.lit(True))

    def mean(c: str):
        x = F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        if weight is None:
            return F.avg(x)
        w = F.when(x.isNotNull() & (F.col(weight) > 0), F.col(weight).cast("double"))
        return F.try_divide(F.sum(x * w), F.sum(w))

    return per_stratum.where(informative).groupBy("effect_type").agg(F.count(F.lit(1)).alias("n_strata"), F.array_join(F.array_sort(F.collect_list("stratum")), ",").alias("strata"), *[mean(c).alias(f"macro_{c}") for c in values])


def unjudged_at_k(stage: DataFrame) -> DataFrame:
    """Per (query, world): how many of the top k are unjudged."""
    where = {"A": (N.E_RERANK, "rank_treatment"), "B": (N.E_RERANK, "rank_control"), "C": (N.E_GATE, "rank_control")}
    world = F.array(*[F.when((F.col("effect_type") == kind) & (F.col(rank) <= F.col("k")), F.lit(w)) for w, (kind, rank) in where.items()])
    rows = stage.withColumn("world", F.explode(F.array_compact(world)))
    got = rows.groupBy("query_id", "world", "k_c", "k").agg(F.count(F.lit(1)).alias("n_top"), F.sum((~F.coalesce("judged", F.lit(False))).cast("long")).alias("n_unjudged"))
    return got.withColumn("share_unjudged", F.col("n_unjudged") / F.col("n_top"))


def label(g, r, tau: float):
    """Gate-sensitive by a strict comparison; a tie goes to reranking."""
    return F.when((g > tau) & (g > r), N.GATE_SENSITIVE).when((r > tau) & (r >= F.greatest(g, F.lit(0.0))), N.RERANK_SENSITIVE).otherwise(N.MIXED)


def diagnose(stage: DataFrame, tau: float = 0.05) -> DataFrame:
    """Per query: what the gate costs (g_q), what reranking moves (r_q) and the label that follows.

    Document effects add up to differences of the rankings' utilities. One mode at a time: rows of
    both modes in one frame are kept apart by the condensed column.
    """

    def total(kind: str, column: str):
        return F.sum(F.when(F.col("effect_type") == kind, F.col(column)).otherwise(F.lit(0.0)))

    got = stage.groupBy("query_id", "stage1_system", "k_c", "condensed").agg(total(N.E_RERANK, "utility_treatment").alias("dcg_actual"), (-total(N.E_GATE, "effect")).alias("g_q"), total(N.E_RERANK, "effect").alias("rerank_signed"))
    got = got.withColumn("r_q", F.abs("rerank_signed")).withColumn("reranker_harms", F.col("rerank_signed") < 0)
    return got.withColumn("label", label(F.col("g_q"), F.col("r_q"), tau))


def budget_outcomes(budget: DataFrame) -> DataFrame:
    """Utility at t minus utility at t = 1 per (query, policy, t); random: the mean over its seeds."""
    runs = budget.groupBy("query_id", "k_c", "condensed", "policy", "t", "seed").agg(F.sum("effect").alias("delta"))
    return runs.groupBy("query_id", "k_c", "condensed", "policy", "t").agg(F.avg("delta").alias("delta_dcg"))


def outcomes_by_label(diagnosis: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Mean outcome of gate- and rerank-sensitive queries per (policy, t), and their difference."""
    both = outcomes.join(diagnosis.select("query_id", "k_c", "condensed", "label"), ["query_id", "k_c", "condensed"], "left")
    gate, rerank = F.col("label") == N.GATE_SENSITIVE, F.col("label") == N.RERANK_SENSITIVE
    got = both.groupBy("k_c", "condensed", "policy", "t").agg(
        F.count(F.lit(1)).alias("n_queries"), F.sum(gate.cast("long")).alias("n_gate_sensitive"), F.sum(rerank.cast("long")).alias("n_rerank_sensitive"),
        F.avg(F.when(gate, F.col("delta_dcg"))).alias("mean_gate"), F.avg(F.when(rerank, F.col("delta_dcg"))).alias("mean_rerank"),
    )
    return got.withColumn("difference", F.when((F.col("n_gate_sensitive") > 1) & (F.col("n_rerank_sensitive") > 1), F.col("mean_gate") - F.col("mean_rerank")))


def paired_labels(first: DataFrame, second: DataFrame, which: str = N.GATE_SENSITIVE) -> DataFrame:
    """Discordant counts of a label between two systems on the same queries."""
    a = first.select("query_id", (F.col("label") == which).alias("a"))
    b = second.select("query_id", (F.col("label") == which).alias("b"))
    both = a.join(b, "query_id", "full").where(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit("a paired contrast needs both systems on the same queries")).cast("boolean")))

    def n(c):
        return F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))

    return both.agg(F.count(F.lit(1)).alias("n_queries"), n(F.col("a")).alias("n_a"), n(F.col("b")).alias("n_b"), n(F.col("a") & F.col("b")).alias("both"), n(F.col("a") & ~F.col("b")).alias("only_a"), n(~F.col("a") & F.col("b")).alias("only_b"))


def promotion(budget: DataFrame, stage: DataFrame, relevant: DataFrame, n_queries: int) -> DataFrame:
    """Per (policy, t): what the promoted outsiders were, averaged over seeds."""
    key = ["query_id", "doc_id"]
    fail = gating_failures(stage, N.FINE_EPS).select(*key).distinct().withColumn("failure", F.lit(True))
    good = relevant.select(*key).distinct().withColumn("relevant", F.lit(True))
    p = budget.where(F.col("stratum") == N.SELECTED).join(fail, key, "left").join(good, key, "left")
    runs = p.groupBy("policy", "t", "seed").agg(
        F.count(F.lit(1)).alias("n_promoted"), F.avg(F.coalesce("judged", F.lit(False)).cast("double")).alias("share_judged"), F.avg(F.coalesce("relevant", F.lit(False)).cast("double")).alias("share_relevant"),
        F.avg((F.col("utility_treatment") > N.FINE_EPS).cast("double")).alias("share_reached_top_k"), F.sum(F.coalesce("failure", F.lit(False)).cast("long")).alias("gating_failures_promoted"),
    )
    names = ["n_promoted", "share_judged", "share_relevant", "share_reached_top_k", "gating_failures_promoted"]
    return runs.groupBy("policy", "t").agg(*[F.avg(c).alias(c) for c in names], (F.avg("n_promoted") / n_queries).alias("promoted_per_query"), F.count(F.lit(1)).alias("n_seeds"))


def false_negatives(budget: DataFrame, stage: DataFrame) -> DataFrame:
    """Per (policy, t): the share of gating failures that the policy left out, averaged over seeds."""
    key = ["query_id", "doc_id"]
    fail = gating_failures(stage, N.FINE_EPS).select(*key).distinct()
    runs = budget.select("policy", "t", "seed").distinct()
    promoted = budget.where(F.col("stratum") == N.SELECTED).select("policy", "t", F.coalesce("seed", F.lit(-1)).alias("s"), *key).distinct().withColumn("hit", F.lit(True))
    every = fail.join(F.broadcast(runs.withColumn("s", F.coalesce("seed", F.lit(-1)))))  # a few runs beside each failure
    hit = every.join(promoted, ["policy", "t", "s", *key], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    by_query = hit.groupBy("policy", "t", "s", "query_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("hit").cast("long")).alias("found"))
    per = by_query.groupBy("policy", "t", "s").agg(F.sum("n").alias("gating_failures"), F.sum("found").alias("found"), F.count(F.lit(1)).alias("queries_with_failures"), F.sum((F.col("found") == 0).cast("long")).alias("queries_all_missed"))
    per = per.withColumn("false_negative_rate", 1 - F.col("found") / F.col("gating_failures"))
    names = ["gating_failures", "found", "false_negative_rate", "queries_with_failures", "queries_all_missed"]
    return per.groupBy("policy", "t").agg(*[F.avg(c).alias(c) for c in names], F.count(F.lit(1)).alias("n_seeds"))


def setting_metrics(stage: DataFrame, tau: float = 0.05) -> DataFrame:
    """Long (system, k_c, utility, k, condensed, metric, value) of every setting in the effect table."""
    key = ["stage1_system", "k_c", "utility", "k", "condensed"]

    def total(kind: str, column: str):
        return F.sum(F.when(F.col("effect_type") == kind, F.col(column)).otherwise(F.lit(0.0)))

    q = stage.groupBy(*key, "query_id").agg(
        total(N.E_RERANK, "utility_treatment").alias("act"), (-total(N.E_GATE, "effect")).alias("g"), total(N.E_RERANK, "effect").alias("signed"),
        F.sum(((F.col("effect_type") == N.E_GATE) & (F.col("stratum") == N.NON_SURVIVOR) & (F.col("utility_control") > N.EPS)).cast("long")).alias("fails"),
    )
    q = S.written(q.withColumn("r", F.abs("signed")).withColumn("label", label(F.col("g"), F.col("r"), tau)), "query-sums")
    metrics = {
        "n_queries": F.count(F.lit(1)), "utility_actual_mean": F.avg("act"), "g_q_mean": F.avg("g"), "r_q_mean": F.avg("r"), "rerank_signed_mean": F.avg("signed"),
        **{f"n_{k}": F.sum((F.col("label") == k).cast("long")) for k in (N.GATE_SENSITIVE, N.RERANK_SENSITIVE, N.MIXED)},
        "n_reranker_harms": F.sum((F.col("signed") < 0).cast("long")), "n_gating_failures": F.sum("fails"), "n_queries_with_gating_failure": F.sum((F.col("fails") > 0).cast("long")),
    }
    wide = q.groupBy(*key).agg(*[v.cast("double").alias(k) for k, v in metrics.items()])
    wide = S.matched(wide, S.quantiles(q, "g", {"g_q_median": 0.5}, key), key, "left")
    return wide.unpivot(key, [*metrics, "g_q_median"], "metric", "value")


def outcome_metrics(budget: DataFrame) -> DataFrame:
    """Mean change by policy and share of every setting, in the long form of :func:`setting_metrics`; a
    query's random runs are averaged first."""
    key = ["stage1_system", "k_c", "utility", "k", "condensed"]
    runs = budget.groupBy(*key, "query_id", "policy", "t", "seed").agg(F.sum("effect").alias("delta"))
    per = runs.groupBy(*key, "query_id", "policy", "t").agg(F.avg("delta").alias("delta"))
    got = per.groupBy(*key, "policy", "t").agg(F.avg("delta").alias("value"))
    return got.select(*key, F.concat(F.lit("delta_"), "policy", F.lit("_t"), F.regexp_replace(F.col("t").cast("string"), r"\.0$", "")).alias("metric"), "value")


def one_axis(long: DataFrame, headline: dict, first: str, second: str) -> DataFrame:
    """Settings at most one axis away from ``headline``, two systems side by side."""
    axes = list(headline)
    off = {a: F.col(a) != F.lit(headline[a]) for a in axes}
    many = sum((o.cast("int") for o in off.values()), F.lit(0))
    varied, setting = F.lit("headline"), F.lit("")
    for a in reversed(axes):
        varied, setting = F.when(off[a], a).otherwise(varied), F.when(off[a], F.col(a).cast("string")).otherwise(setting)
    near = long.where(many <= 1).withColumn("varied", varied).withColumn("setting", setting)
    got = near.groupBy("varied", "setting", *axes, "metric").agg(*[F.max(F.when(F.col("stage1_system") == s, F.col("value"))).alias(n) for s, n in ((first, "first"), (second, "second"))])
    return got.withColumn("difference", F.col("first") - F.col("second"))
