"""Approximate e_gate from a few extra scorer calls per query.

A probe scores b outsiders that a policy picks. The probed world ranks the candidates and these;
documents outside it keep an effect of 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import names as N
from ..errors import InputError
from ..functions.statistics import average_rank, correlation
from ..functions.utility import Utility
from . import resample

KEY = ["query_id", "k_c", "condensed"]


def probe(worlds: DataFrame, budgets: Sequence[int], policy: str, utility: Utility, seeds: Sequence[int] = (42,)) -> DataFrame:
    """(query_id, doc_id, k_c, condensed, budget, probed, effect): e_gate as b calls would show it, per budget.

    The random policy takes outsiders in the order of the MD5 digest of "seed/query_id/doc_id", gives a
    row per seed and adds a seed column.
    """
    outside = Window.partitionBy(*KEY, "in_cq")
    cells, run = worlds, ["budget"]
    if policy == N.RANDOM:
        cells, run = worlds.withColumn("seed", F.explode(F.array(*map(F.lit, seeds)))), ["budget", "seed"]
        place = F.row_number().over(Window.partitionBy(*KEY, "in_cq", "seed").orderBy(F.md5(F.concat_ws("/", "seed", "query_id", "doc_id")), "doc_id"))
    elif policy == N.ALTERNATIVE:
        place = F.row_number().over(outside.orderBy(F.coalesce("alt_rank", F.lit(N.UNRANKED)), "doc_id"))
    elif policy == N.BOUNDARY:
        place = F.col("rank_s1") - F.col("k_c")
    else:
        raise InputError(f"unknown policy {policy!r}")
    cells = cells.withColumn("place", F.when(~F.col("in_cq"), place)).withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    cells = cells.withColumn("probed", ~F.col("in_cq") & (F.col("place") <= F.col("budget"))).where("in_cq or probed")
    ranked = cells.withColumn("rank_p", F.row_number().over(Window.partitionBy(*KEY, *run).orderBy("rank_s2")))
    u = utility.of(F.col("rank_a"), F.col("relevance")) - utility.of(F.col("rank_p"), F.col("relevance"))
    return ranked.select("query_id", "doc_id", "k_c", "condensed", *run, "probed", u.alias("effect"))


def full_probe(worlds: DataFrame, utility: Utility) -> DataFrame:
    """A probe of every outsider; a row whose effect is not the gate's is refused."""
    u = {w: utility.of(F.col(f"rank_{w}"), F.col("relevance")) for w in "ac"}
    ranked = worlds.withColumn("rank_p", F.row_number().over(Window.partitionBy(*KEY).orderBy("rank_s2")))
    effect = u["a"] - utility.of(F.col("rank_p"), F.col("relevance"))
    same = F.when(F.abs(effect - (u["a"] - u["c"])) <= N.EPS, effect).otherwise(F.raise_error(F.lit("probing every outsider does not give the effects of the gate")).cast("double"))
    return ranked.select("query_id", "doc_id", "k_c", "condensed", same.alias("effect"))


def query_fidelity(probed: DataFrame, diagnosis: DataFrame, tau: float = 0.05) -> DataFrame:
    """Per budget (and seed): calls spent, the approximate g_q against the reference's, and how well the
    gate-sensitive label that it implies agrees.

    Ranks are taken at nine places, so that the order of a sum does not part equal queries.
    """
    run = [c for c in ("budget", "seed") if c in probed.columns]
    hat = probed.groupBy("query_id", *run).agg((-F.sum("effect")).alias("g_hat"), F.sum(F.col("probed").cast("long")).alias("calls"))
    both = hat.join(diagnosis.select("query_id", "g_q", "r_q", (F.col("label") == N.GATE_SENSITIVE).alias("so")), "query_id")
    both = both.withColumns({"said": (F.col("g_hat") > tau) & (F.col("g_hat") > F.col("r_q")), "_h": F.round("g_hat", 9) + F.lit(0.0), "_g": F.round("g_q", 9) + F.lit(0.0)})
    both = both.withColumns({"_hr": average_rank("_h", run), "_gr": average_rank("_g", run)})
    count = {"tp": F.col("said") & F.col("so"), "fp": F.col("said") & ~F.col("so"), "fn": F.col("so") & ~F.col("said")}
    got = both.groupBy(*run).agg(
        F.count(F.lit(1)).alias("n_queries"), F.avg("calls").alias("calls_per_query"), F.avg(F.abs(F.col("g_hat") - F.col("g_q"))).alias("gq_mae"), F.avg("g_hat").alias("g_hat_mean"),
        correlation("_hr", "_gr").alias("gq_spearman"), *[F.sum(c.cast("long")).alias(n) for n, c in count.items()],
    )
    tp = F.col("tp").cast("double")
    got = got.withColumns({"precision": F.try_divide(tp, F.col("tp") + F.col("fp")), "recall": F.try_divide(tp, F.col("tp") + F.col("fn"))})
    return got.withColumn("f1", F.coalesce(F.try_divide(2 * tp, 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))


def query_intervals(probed: DataFrame, diagnosis: DataFrame, draws: int = 1000, alpha: float = 0.05, seed: int = 42, tau: float = 0.05) -> DataFrame:
    """(budget, seed if there are, statistic, point, lo, hi, n_draws) of :func:`query_fidelity` over queries.

    Statistics are gq_mae, gq_spearman on the ranks of the whole sample, precision, recall and f1.
    """
    run = [c for c in ("budget", "seed") if c in probed.columns]
    hat = probed.groupBy("query_id", *run).agg((-F.sum("effect")).alias("g_hat"))
    both = hat.join(diagnosis.select("query_id", "g_q", "r_q", (F.col("label") == N.GATE_SENSITIVE).alias("so")), "query_id")
    both = both.withColumns({"said": (F.col("g_hat") > tau) & (F.col("g_hat") > F.col("r_q")), "_h": F.round("g_hat", 9) + F.lit(0.0), "_g": F.round("g_q", 9) + F.lit(0.0)})
    both = both.withColumns({"_hr": average_rank("_h", run), "_gr": average_rank("_g", run)})
    said, so = F.col("said"), F.col("so")
    parts = {"n": F.lit(1.0), "error": F.abs(F.col("g_hat") - F.col("g_q")), **{k: c.cast("double") for k, c in (("tp", said & so), ("fp", said & ~so), ("fn", so & ~said))}, **resample.moments("_hr", "_gr", "r_")}
    sums = both.select(*run, "query_id", *[c.alias(k) for k, c in parts.items()])
    statistics = {
        "gq_mae": resample.weighted_mean("error", "n"),
        "gq_spearman": resample.weighted_correlation("n", "r_x", "r_y", "r_xx", "r_yy", "r_xy"),
        "precision": lambda s: F.try_divide(s("tp"), s("tp") + s("fp")),
        "recall": lambda s: F.try_divide(s("tp"), s("tp") + s("fn")),
        "f1": lambda s: F.coalesce(F.try_divide(2 * s("tp"), 2 * s("tp") + s("fp") + s("fn")), F.lit(0.0)),
    }
    return resample.replicate_intervals(sums, run, statistics, list(parts), draws, alpha, seed)


def failures_found(probed: DataFrame, failures: DataFrame) -> DataFrame:
    """Per budget: gating failures whose loss the probe sees, and the share of the loss."""
    budgets = F.broadcast(probed.select("budget").distinct())
    own = failures.select("query_id", "doc_id", F.col("effect").alias("lost")).join(budgets)
    seen = probed.where(F.col("effect") < -N.FINE_EPS).select("query_id", "doc_id", "budget", F.lit(True).alias("seen"))
    got = own.join(seen, ["query_id", "doc_id", "budget"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    return got.groupBy("budget").agg(F.count(F.lit(1)).alias("failures"), F.sum(F.col("seen").cast("long")).alias("found"), F.try_divide(F.sum(F.when(F.col("seen"), F.col("lost")).otherwise(0.0)), F.sum("lost")).alias("loss_recovered_share"))
