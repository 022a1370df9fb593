"""Registered queries and the SQL that has to give the same rows.

Every query works on a cascade over a whole data table. Doubles are rounded to nine places on both
sides, ranks are 64-bit.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contracts
from .. import names as N
from ..config import Settings
from ..functions import statistics as S
from ..functions.utility import Utility, ndcg, recall
from ..operators import allocation, effects, features, judgments, probes, ranking, resample, summaries, universe, worlds
from ..sources import retrieval, score_store
from ..sources.tables import table
from . import feasibility, grid, reports, sql, study
from .cascades import event_cascade, event_qrels, event_runs
from .sql import K_C, T_GRID, K, r

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DCG, TOPK, RBP = Utility("dcg", K), Utility("topk", K), Utility("rbp", K)
DEPTH = 60


def query(oracle: str | None = None, name: str | None = None):
    """Register a query, and its SQL where it has one."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if oracle:
            ORACLES[key] = oracle
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at nine places without a negative zero, integers as long."""
    out = []
    for c, kind in df.dtypes:
        col = F.col(f"`{c}`")
        out.append((F.round(col, 9) + F.lit(0.0)).alias(c) if kind == "double" else col.cast("long").alias(c) if kind in ("int", "smallint") else col)
    return df.select(*out)


def _worlds(spark, d, modes=(False,), swapped=False, depths=(K_C,)):
    return worlds.build_worlds(event_cascade(spark, d, swapped), list(depths), list(modes))


def _stage(spark, d, u=DCG, modes=(False,), swapped=False, depths=(K_C,)):
    return effects.stage_effects(_worlds(spark, d, modes, swapped, depths), u)


def _allocated(spark, d, policies=(N.BOUNDARY, N.ALTERNATIVE), seeds=(42,)):
    grid = allocation.parameters(spark, [K_C], T_GRID, policies, seeds)
    return allocation.allocate(_worlds(spark, d), grid)


def _budget(spark, d, u=DCG, policies=(N.BOUNDARY, N.ALTERNATIVE), seeds=(42,)):
    return effects.budget_effects(_allocated(spark, d, policies, seeds), u)


# Orders and worlds


@query(f"WITH {sql.events()}, {sql.RANKED} SELECT query_id, doc_id, {r('s1', 's1')}, rank_s1 AS rank FROM rk")
def order_by(spark, d):
    return rounded(ranking.rank_by(event_cascade(spark, d), "s1").select("query_id", "doc_id", "s1", "rank"))


@query(f"WITH {sql.events()}, {sql.RANKED} SELECT query_id, doc_id, rank_s1 AS rank FROM rk WHERE rank_s1 <= {K_C}")
def topk_candidates(spark, d):
    return rounded(ranking.top_k(event_cascade(spark, d), "s1", K_C).select("query_id", "doc_id", "rank"))


@query(f"WITH {sql.worlds((K_C, 30), (False, True))} SELECT query_id, doc_id, CAST(k_c AS BIGINT) AS k_c, condensed, in_cq, rank_a, rank_b, rank_c FROM w")
def worlds_abc(spark, d):
    return rounded(_worlds(spark, d, (False, True), depths=(K_C, 30)).select("query_id", "doc_id", "k_c", "condensed", "in_cq", "rank_a", "rank_b", "rank_c"))


@query(f"WITH {sql.worlds((K_C, 30), (False, True))} SELECT query_id, doc_id, CAST(k_c AS BIGINT) AS k_c, condensed, in_cq, rank_a, rank_b, rank_c FROM w")
def worlds_in_ranges(spark, d):
    """The worlds where no task holds a whole query."""
    rows = worlds.build_worlds(event_cascade(spark, d), [K_C, 30], [False, True], ranges=2 * ranking.tasks(table(spark, d, "events")))
    return rounded(rows.select("query_id", "doc_id", "k_c", "condensed", "in_cq", "rank_a", "rank_b", "rank_c"))


@query(f"WITH {sql.worlds()} SELECT query_id, 0 AS n FROM w WHERE (rank_a IS NULL) <> (rank_b IS NULL)")
def isolation_violations(spark, d):
    return worlds.isolation_violations(_worlds(spark, d)).select("query_id", F.lit(0).alias("n"))


@query(f"WITH {sql.worlds((K_C,), (True,))} SELECT query_id, doc_id, rank_a FROM w WHERE in_cq")
def condensed_cascade(spark, d):
    inside = ranking.top_k(event_cascade(spark, d), "s1", K_C).drop("rank")
    return rounded(ranking.condense(ranking.rank_by(inside, "s2", "rank_a"), "rank_a").select("query_id", "doc_id", "rank_a"))


# Effects

_STAGE = "query_id, doc_id, effect_type, stratum, judged, rank_treatment, rank_control, " + ", ".join(r(c, c) for c in ("utility_treatment", "utility_control", "effect"))


def _stage_columns(df):
    return rounded(df.select("query_id", "doc_id", "effect_type", "stratum", "judged", "rank_treatment", "rank_control", "utility_treatment", "utility_control", "effect"))


for _u in (DCG, TOPK, RBP):
    query(f"WITH {sql.stage(_u)} SELECT {_STAGE} FROM st", f"stage_effects_{_u.kind}")(lambda spark, d, u=_u: _stage_columns(_stage(spark, d, u)))


@query(f"WITH {sql.stage(DCG, modes=(True,))} SELECT {_STAGE} FROM st")
def stage_effects_condensed(spark, d):
    return _stage_columns(_stage(spark, d, modes=(True,)))


_SHARES = (1.0, 0.9, 0.75, 0.5, 0.29, 0.25, 0.0)


@query(f"WITH {sql.events()} SELECT query_id, b AS budget, t, CAST(floor(t * b) AS BIGINT) AS n_cand, b - CAST(floor(t * b) AS BIGINT) AS n_out FROM (SELECT query_id, count(*) AS b FROM ev GROUP BY ALL), (SELECT unnest([{', '.join(f'CAST({t} AS DOUBLE)' for t in _SHARES)}]) AS t)")
def split_budget(spark, d):
    """Each query's budget is the number of its documents."""
    budgets = event_cascade(spark, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("budget"))
    return rounded(allocation.split_budget(budgets, _SHARES))


for _p in (N.BOUNDARY, N.ALTERNATIVE):
    query(f"WITH {sql.allocated((_p,))} SELECT query_id, doc_id, t, policy, stratum, submitted FROM ta", f"alloc_{_p}")(lambda spark, d, p=_p: _allocated(spark, d, (p,)).select("query_id", "doc_id", "t", "policy", "stratum", "submitted"))


@query(f"WITH {sql.allocated()} SELECT query_id, doc_id, t, policy, stratum, submitted, rank_t FROM ta")
def alloc_in_ranges(spark, d):
    """Both policies by place where no task holds a whole query."""
    cells, ranges = allocation.parameters(spark, [K_C], T_GRID, (N.BOUNDARY, N.ALTERNATIVE)), 2 * ranking.tasks(table(spark, d, "events"))
    got = allocation.allocate(worlds.build_worlds(event_cascade(spark, d), [K_C], ranges=ranges), cells, ranges)
    return rounded(got.select("query_id", "doc_id", "t", "policy", "stratum", "submitted", "rank_t"))


@query()
def alloc_random(spark, d):
    return _allocated(spark, d, (N.RANDOM,), (42, 43, 44)).select("query_id", "doc_id", "t", "policy", "seed", "stratum", "submitted")


@query(f"WITH {sql.allocated()} SELECT query_id, policy, t, max(n_cand) AS n_cand, max(n_out) AS n_out, count(*) FILTER (stratum = 'retained') AS retained, count(*) FILTER (stratum = 'removed') AS removed, count(*) FILTER (stratum = 'selected_outsider') AS selected, count(*) FILTER (stratum = 'unselected_outsider') AS unselected, true AS valid FROM ta GROUP BY ALL")
def allocation_audit(spark, d):
    return rounded(allocation.audit(_allocated(spark, d)).select("query_id", "policy", "t", "n_cand", "n_out", "retained", "removed", "selected", "unselected", "valid"))


@query(f"WITH {sql.allocated()} SELECT query_id, doc_id, policy, t, rank_t FROM ta WHERE submitted")
def t_world_ranks(spark, d):
    return rounded(_allocated(spark, d).where("submitted").select("query_id", "doc_id", "policy", "t", "rank_t"))


_BUDGET = "query_id, doc_id, policy, t, stratum, rank_t AS rank_treatment, rank_1 AS rank_control, " + r("effect", "effect")
for _p in (N.BOUNDARY, N.ALTERNATIVE):
    query(f"WITH {sql.budget(DCG, (_p,))} SELECT {_BUDGET} FROM bg", f"delta_t_{_p}")(lambda spark, d, p=_p: rounded(_budget(spark, d, policies=(p,)).select("query_id", "doc_id", "policy", "t", "stratum", "rank_treatment", "rank_control", "effect")))


@query()
def delta_t_random(spark, d):
    return rounded(_budget(spark, d, policies=(N.RANDOM,), seeds=(42, 43, 44)).select("query_id", "doc_id", "policy", "seed", "t", "stratum", "rank_treatment", "rank_control", "effect"))


@query(f"WITH {sql.stage(DCG)}, x AS (SELECT effect_type, count(*) AS n FROM st GROUP BY ALL) SELECT effect_type, n, CAST(0 AS BIGINT) AS broken FROM x")
def invariant_violations(spark, d):
    got = effects.violations(_stage(spark, d), DCG.monotone)
    return got.select("effect_type", "n", sum((F.col(c) for c in got.columns if c not in ("effect_type", "n")), F.lit(0).cast("long")).alias("broken"))


@query(f"WITH {sql.stage(DCG)}, a AS (SELECT query_id, doc_id, max(effect) FILTER (effect_type = 'e_rerank') AS er, max(effect) FILTER (effect_type = 'e_gate') AS eg, max(utility_control) FILTER (effect_type = 'e_rerank') AS ub, max(utility_control) FILTER (effect_type = 'e_gate') AS uc FROM st GROUP BY ALL) SELECT query_id, doc_id, {r('er', 'e_rerank')}, {r('eg', 'e_gate')}, {r('er + ub - eg - uc', 'residual')} FROM a")
def additivity(spark, d):
    return rounded(effects.additivity(_stage(spark, d)).select("query_id", "doc_id", "e_rerank", "e_gate", "residual"))


@query(f"""WITH {sql.stage(DCG)}, a AS (SELECT query_id, doc_id, stratum, abs(max(effect) FILTER (effect_type = 'e_gate')) AS g, abs(max(effect) FILTER (effect_type = 'e_rerank')) AS rr, max(utility_control) FILTER (effect_type = 'e_gate') AS u FROM st GROUP BY ALL)
SELECT query_id, doc_id, CASE WHEN stratum = 'non_survivor' AND u > 1e-9 THEN 'gating_failure' WHEN g > 0.05 AND rr > 0.05 THEN 'jointly_sensitive' WHEN g > 0.05 THEN 'gate_sensitive' WHEN rr > 0.05 THEN 'rerank_sensitive' ELSE 'stable' END AS label FROM a""")
def document_labels(spark, d):
    return effects.document_labels(_stage(spark, d)).select("query_id", "doc_id", "label")


@query(f"WITH {sql.stage(DCG)}, {sql.FAILURES} SELECT query_id, doc_id, rank_control, {r('utility_control', 'lost')} FROM gf")
def gating_failures(spark, d):
    return rounded(effects.gating_failures(_stage(spark, d)).select("query_id", "doc_id", "rank_control", F.col("utility_control").alias("lost")))


@query(f"WITH {sql.stage(DCG)}, {sql.FAILURES}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY effect, rank_control, doc_id) AS n FROM gf) SELECT query_id, doc_id, {r('effect', 'effect')} FROM f WHERE n = 1 ORDER BY f.effect, rank_control, query_id, doc_id LIMIT 10")
def worst_failures(spark, d):
    return rounded(effects.worst_failures(_stage(spark, d), 10).select("query_id", "doc_id", "effect"))


@query(f"WITH {sql.allocated()} SELECT query_id, doc_id, policy, t, coalesce(rank_t <= {K}, false) AS entered_top_k FROM ta WHERE stratum = 'selected_outsider' AND t <> 1.0")
def recovered_outsiders(spark, d):
    return effects.recovered_outsiders(_budget(spark, d)).select("query_id", "doc_id", "policy", "t", "entered_top_k")


# Summaries


@query(f"WITH {sql.stage(DCG)} SELECT effect_type, stratum, count(*) AS n_documents, count(DISTINCT query_id) AS n_queries, count(*) FILTER (judged) AS n_judged, {r('avg(effect)', 'mean_effect')}, {r('avg(abs(effect))', 'mean_abs_effect')} FROM st GROUP BY ALL")
def strata_sizes(spark, d):
    return rounded(summaries.strata_sizes(_stage(spark, d)))


@query(f"WITH {sql.stage(DCG)}, s AS (SELECT effect_type, stratum, count(*) AS n_documents FROM st GROUP BY ALL) SELECT * FROM s WHERE n_documents < 1000")
def thin_strata(spark, d):
    return summaries.thin_strata(_stage(spark, d), 1000).select("effect_type", "stratum", "n_documents")


@query(f"WITH {sql.stage(DCG, modes=(False, True))} SELECT effect_type, CAST(k_c AS BIGINT) AS k_c, condensed, stratum, count(*) AS n, count(*) FILTER (judged) AS n_judged, {r('avg(effect)', 'mean')}, {r('avg(abs(effect))', 'mean_abs')}, {r('max(abs(effect))', 'max_abs')} FROM st GROUP BY ALL")
def effect_summary(spark, d):
    return rounded(summaries.effect_summary(_stage(spark, d, modes=(False, True))).drop("stage1_system", "utility", "t", "policy"))


_QUANTILES = ", ".join(r(f"quantile_cont(effect, {q})", f"q{int(q * 100):02d}") for q in summaries.QUANTILES)


@query(f"WITH {sql.budget(DCG)} SELECT t, policy, stratum, count(*) AS n, count(DISTINCT query_id) AS n_queries, {r('avg(effect)', 'mean')}, {r('stddev_samp(effect)', 'sd')}, {r('avg(CASE WHEN abs(effect) > 1e-9 THEN 1.0 ELSE 0.0 END)', 'share_nonzero')}, {_QUANTILES} FROM bg WHERE judged GROUP BY ALL")
def effect_distributions(spark, d):
    return rounded(summaries.distributions(_budget(spark, d), judged_only=True).drop("condensed", "effect_type", "k_c", "judged_only"))


@query(f"WITH {sql.stage(DCG)}, s AS (SELECT effect_type, stratum, avg(effect) AS m FROM st WHERE NOT (effect_type = 'e_rerank' AND stratum = 'non_survivor') GROUP BY ALL) SELECT effect_type, count(*) AS n_strata, string_agg(stratum, ',' ORDER BY stratum) AS strata, {r('avg(m)', 'macro_mean_effect')} FROM s GROUP BY ALL")
def macro_average(spark, d):
    return rounded(summaries.macro_average(summaries.strata_sizes(_stage(spark, d)), ["mean_effect"]))


@query(f"""WITH {sql.stage(DCG)}, x AS (SELECT query_id, judged, 'A' AS world FROM st WHERE effect_type = 'e_rerank' AND rank_treatment <= {K} UNION ALL SELECT query_id, judged, 'B' FROM st WHERE effect_type = 'e_rerank' AND rank_control <= {K} UNION ALL SELECT query_id, judged, 'C' FROM st WHERE effect_type = 'e_gate' AND rank_control <= {K})
SELECT query_id, world, count(*) AS n_top, count(*) FILTER (NOT judged) AS n_unjudged, {r('count(*) FILTER (NOT judged) / count(*)', 'share_unjudged')} FROM x GROUP BY ALL""")
def unjudged_at_k(spark, d):
    return rounded(summaries.unjudged_at_k(_stage(spark, d)).drop("k_c", "k"))


@query(f"WITH {sql.stage(DCG, modes=(False, True))}, {sql.DIAGNOSIS} SELECT query_id, condensed, {r('dcg_actual', 'dcg_actual')}, {r('g_q', 'g_q')}, {r('r_q', 'r_q')}, {r('rerank_signed', 'rerank_signed')}, reranker_harms, label FROM dg")
def query_diagnosis(spark, d):
    got = summaries.diagnose(_stage(spark, d, modes=(False, True)))
    return rounded(got.select("query_id", "condensed", "dcg_actual", "g_q", "r_q", "rerank_signed", "reranker_harms", "label"))


@query(f"WITH {sql.budget(DCG)} SELECT query_id, policy, t, {r('sum(effect)', 'delta_dcg')} FROM bg GROUP BY ALL")
def budget_outcomes(spark, d):
    return rounded(summaries.budget_outcomes(_budget(spark, d)).select("query_id", "policy", "t", "delta_dcg"))


def _replace_base(text: str) -> str:
    """The budget's expressions after the stage's, whose base tables they share."""
    return text[text.index("pl AS") :]


_BOTH = f"{sql.stage(DCG)}, {_replace_base(sql.budget(DCG))}"


@query(f"""WITH {_BOTH}, {sql.DIAGNOSIS}, o AS (SELECT query_id, policy, t, sum(effect) AS delta FROM bg GROUP BY ALL), j AS (SELECT o.*, label FROM o LEFT JOIN dg USING (query_id))
SELECT policy, t, count(*) AS n_queries, count(*) FILTER (label = 'gate_sensitive') AS n_gate_sensitive, count(*) FILTER (label = 'rerank_sensitive') AS n_rerank_sensitive, {r("avg(delta) FILTER (label = 'gate_sensitive')", 'mean_gate')}, {r("avg(delta) FILTER (label = 'rerank_sensitive')", 'mean_rerank')} FROM j GROUP BY ALL""")
def h7_groups(spark, d):
    got = summaries.outcomes_by_label(summaries.diagnose(_stage(spark, d)), summaries.budget_outcomes(_budget(spark, d)))
    return rounded(got.drop("k_c", "condensed", "difference"))


@query(f"""SELECT count(*) AS n_queries, count(*) FILTER (a) AS n_a, count(*) FILTER (b) AS n_b, count(*) FILTER (a AND b) AS "both", count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b FROM
(WITH {sql.stage(DCG)}, {sql.DIAGNOSIS} SELECT query_id, label = 'gate_sensitive' AS a FROM dg) JOIN (WITH {sql.stage(DCG, swapped=True)}, {sql.DIAGNOSIS} SELECT query_id, label = 'gate_sensitive' AS b FROM dg) USING (query_id)""")
def label_contrast(spark, d):
    return summaries.paired_labels(*(summaries.diagnose(_stage(spark, d, swapped=s)) for s in (False, True)))


@query(f"""WITH {_BOTH}, {sql.FAILURES}, p AS (SELECT bg.*, gf.doc_id IS NOT NULL AS failure, coalesce(bg.relevance, 0) >= 2 AS relevant FROM bg LEFT JOIN (SELECT query_id, doc_id FROM gf) gf USING (query_id, doc_id) WHERE bg.stratum = 'selected_outsider')
SELECT policy, t, {r('count(*)', 'n_promoted')}, {r('avg(CASE WHEN judged THEN 1.0 ELSE 0.0 END)', 'share_judged')}, {r('avg(CASE WHEN relevant THEN 1.0 ELSE 0.0 END)', 'share_relevant')}, {r('avg(CASE WHEN utility_treatment > 1e-12 THEN 1.0 ELSE 0.0 END)', 'share_reached_top_k')}, {r('count(*) FILTER (failure)', 'gating_failures_promoted')} FROM p GROUP BY ALL""")
def promotion(spark, d):
    relevant = event_cascade(spark, d).where("relevance >= 2")
    return rounded(summaries.promotion(_budget(spark, d), _stage(spark, d), relevant, 20).drop("promoted_per_query", "n_seeds"))


@query(f"""WITH {_BOTH}, {sql.FAILURES}, h AS (SELECT g.query_id, c.policy, c.t, s.doc_id IS NOT NULL AS hit FROM gf g CROSS JOIN (SELECT DISTINCT policy, t FROM bg) c LEFT JOIN (SELECT * FROM bg WHERE stratum = 'selected_outsider') s ON s.query_id = g.query_id AND s.doc_id = g.doc_id AND s.policy = c.policy AND s.t = c.t),
q AS (SELECT policy, t, query_id, count(*) AS n, count(*) FILTER (hit) AS found FROM h GROUP BY ALL) SELECT policy, t, {r('sum(n)', 'gating_failures')}, {r('sum(found)', 'found')}, {r('1 - sum(found) / sum(n)', 'false_negative_rate')}, {r('count(*)', 'queries_with_failures')}, {r('count(*) FILTER (found = 0)', 'queries_all_missed')} FROM q GROUP BY ALL""")
def false_negatives(spark, d):
    return rounded(summaries.false_negatives(_budget(spark, d), _stage(spark, d)).drop("n_seeds"))


def _metrics(spark, d):
    """Settings that differ from the headline in utility, cutoff, depth or mode, for two first stages."""
    value, mix = (effects.stage_effects(_worlds(spark, d, (False, True), swapped, (K_C, 30)), _AXES, system) for swapped, system in ((False, "value"), (True, "mix")))
    return summaries.setting_metrics(value.unionByName(mix))


_AXES = (DCG, TOPK, Utility("dcg", 5))


def _metrics_sql(u: Utility, swapped: bool) -> str:
    labels = ", ".join(f"CAST(count(*) FILTER (label = '{k}') AS DOUBLE) AS n_{k}" for k in (N.GATE_SENSITIVE, N.RERANK_SENSITIVE, N.MIXED))
    return f"""(WITH {sql.stage(u, (K_C, 30), (False, True), swapped)}, {sql.DIAGNOSIS}, f AS (SELECT query_id, k_c, condensed, count(*) AS fails FROM st WHERE effect_type = 'e_gate' AND stratum = 'non_survivor' AND utility_control > 1e-9 GROUP BY ALL)
 SELECT '{"mix" if swapped else "value"}' AS system, '{u.kind}' AS utility, {u.k} AS k, dg.k_c, dg.condensed, CAST(count(*) AS DOUBLE) AS n_queries, avg(dcg_actual) AS utility_actual_mean, avg(g_q) AS g_q_mean, median(g_q) AS g_q_median, avg(r_q) AS r_q_mean, avg(rerank_signed) AS rerank_signed_mean, {labels},
 CAST(count(*) FILTER (rerank_signed < 0) AS DOUBLE) AS n_reranker_harms, CAST(sum(coalesce(fails, 0)) AS DOUBLE) AS n_gating_failures, CAST(count(*) FILTER (fails > 0) AS DOUBLE) AS n_queries_with_gating_failure FROM dg LEFT JOIN f ON f.query_id = dg.query_id AND f.k_c = dg.k_c AND f.condensed = dg.condensed GROUP BY ALL)"""


@query(f"""WITH {sql.stage(DCG, (K_C, 30), (False, True))}, {sql.DIAGNOSIS}, f AS (SELECT k_c, condensed, count(*) AS n FROM st WHERE effect_type = 'e_gate' AND stratum = 'non_survivor' AND utility_control > 1e-9 GROUP BY ALL)
SELECT CAST(dg.k_c AS BIGINT) AS k_c, dg.condensed, {r('avg(g_q)', 'g_q_mean')}, {r('median(g_q)', 'g_q_median')}, {r('avg(r_q)', 'r_q_mean')}, {r("CAST(count(*) FILTER (label = 'gate_sensitive') AS DOUBLE)", 'n_gate_sensitive')}, {r('CAST(max(coalesce(f.n, 0)) AS DOUBLE)', 'n_gating_failures')} FROM dg LEFT JOIN f ON f.k_c = dg.k_c AND f.condensed = dg.condensed GROUP BY ALL""")
def setting_metrics(spark, d):
    got = summaries.setting_metrics(_stage(spark, d, modes=(False, True), depths=(K_C, 30)))
    wanted = ["g_q_mean", "g_q_median", "r_q_mean", "n_gate_sensitive", "n_gating_failures"]
    return rounded(got.groupBy("k_c", "condensed").pivot("metric", wanted).agg(F.first("value")))


_OFF = f"[k_c <> {K_C}, utility <> 'dcg', k <> {K}, condensed]"


@query(
    f"""WITH m AS ({' UNION ALL '.join(_metrics_sql(u, s) for u in _AXES for s in (False, True))}), l AS (UNPIVOT m ON COLUMNS(* EXCLUDE (system, utility, k, k_c, condensed)) INTO NAME metric VALUE value), n AS (SELECT *, {_OFF} AS o FROM l WHERE len(list_filter({_OFF}, lambda x: x)) <= 1)
SELECT CASE WHEN o[1] THEN 'k_c' WHEN o[2] THEN 'utility' WHEN o[3] THEN 'k' WHEN o[4] THEN 'condensed' ELSE 'headline' END AS varied, CASE WHEN o[1] THEN CAST(k_c AS VARCHAR) WHEN o[2] THEN utility WHEN o[3] THEN CAST(k AS VARCHAR) WHEN o[4] THEN 'true' ELSE '' END AS setting, CAST(k_c AS BIGINT) AS k_c, utility, CAST(k AS BIGINT) AS k, condensed, metric,
round(max(value) FILTER (system = 'value'), 9) + 0.0 AS "first", round(max(value) FILTER (system = 'mix'), 9) + 0.0 AS "second", round(max(value) FILTER (system = 'value') - max(value) FILTER (system = 'mix'), 9) + 0.0 AS difference FROM n GROUP BY ALL"""
)
def compare_one_axis(spark, d):
    return rounded(summaries.one_axis(_metrics(spark, d), {"k_c": K_C, "utility": "dcg", "k": K, "condensed": False}, "value", "mix"))


# Retrieval effectiveness


@query(f"""WITH {sql.runs(K)}, {sql.QRELS}, g AS (SELECT ru.query_id, sum(coalesce(CAST(relevance AS DOUBLE), 0.0) * ([{', '.join(repr(1 / math.log2(1 + i)) for i in range(1, K + 1))}])[rank]) AS dcg FROM ru LEFT JOIN qr USING (query_id, doc_id) WHERE system = 'value' GROUP BY ALL),
b AS (SELECT query_id, sum(CAST(relevance AS DOUBLE) * ([{', '.join(repr(1 / math.log2(1 + i)) for i in range(1, K + 1))}])[n]) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS n FROM qr) WHERE n <= {K} GROUP BY ALL)
SELECT query_id, {r('coalesce(dcg, 0.0)', 'dcg')}, {r('ideal', 'ideal')}, {r('CASE WHEN ideal > 0 THEN coalesce(dcg, 0.0) / ideal ELSE 0.0 END', 'ndcg')} FROM b LEFT JOIN g USING (query_id)""")
def trec_ndcg(spark, d):
    return rounded(ndcg(event_runs(spark, d, K).where("system = 'value'"), event_qrels(spark, d), K))


@query(f"""WITH {sql.stage(DCG)}, b AS (SELECT query_id, sum({sql.gain()} * ([{', '.join(repr(1 / math.log2(1 + i)) for i in range(1, K + 1))}])[n]) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {sql.gain()} DESC, doc_id) AS n FROM ev WHERE judged) WHERE n <= {K} GROUP BY ALL),
a AS (SELECT query_id, sum(utility_treatment) AS dcg FROM st WHERE effect_type = 'e_rerank' GROUP BY ALL) SELECT query_id, {r('dcg', 'dcg')}, {r('ideal', 'ideal')}, {r('CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0.0 END', 'ndcg')} FROM b JOIN a USING (query_id)""")
def ndcg_at_k(spark, d):
    top = _worlds(spark, d).where("in_cq").select("query_id", "doc_id", F.col("rank_a").alias("rank"))
    return rounded(ndcg(top, event_qrels(spark, d), K, DCG.gain))


@query(f"""WITH {sql.runs(DEPTH)}, {sql.QRELS}, g AS (SELECT query_id, count(*) FILTER (relevance >= 2) AS relevant FROM qr GROUP BY ALL), h AS (SELECT ru.query_id, count(*) AS found FROM ru JOIN qr USING (query_id, doc_id) WHERE system = 'value' AND relevance >= 2 GROUP BY ALL)
SELECT query_id, relevant, coalesce(found, 0) AS found, round(CAST(coalesce(found, 0) AS DOUBLE) / nullif(relevant, 0), 9) + 0.0 AS recall FROM g LEFT JOIN h USING (query_id)""")
def recall_at_k(spark, d):
    return rounded(recall(event_runs(spark, d, DEPTH).where("system = 'value'"), event_qrels(spark, d), DEPTH))


# Universe and judgments


@query(f"WITH {sql.universe(DEPTH)} SELECT query_id, doc_id, sources FROM un")
def universe_union(spark, d):
    return universe.build(event_runs(spark, d, DEPTH), DEPTH)


@query(f"WITH {sql.universe(DEPTH)}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best_rank, doc_id) AS n FROM un) SELECT query_id, doc_id, sources FROM c WHERE n <= 50")
def universe_capped(spark, d):
    return universe.build(event_runs(spark, d, DEPTH), DEPTH, max_size=50)


@query(f"WITH {sql.universe(DEPTH)} SELECT query_id, count(*) AS n_docs FROM un GROUP BY ALL")
def universe_sizes(spark, d):
    return universe.sizes(universe.build(event_runs(spark, d, DEPTH), DEPTH))


@query(f"""WITH {sql.runs(K_C)}, s AS (SELECT query_id, doc_id, max(CASE WHEN system = 'value' THEN 1 ELSE 0 END) AS a, max(CASE WHEN system = 'mix' THEN 1 ELSE 0 END) AS b FROM ru GROUP BY ALL)
SELECT query_id, CAST(sum(a * b) AS BIGINT) AS n_both, CAST(sum(a * (1 - b)) AS BIGINT) AS n_only_first, CAST(sum(b * (1 - a)) AS BIGINT) AS n_only_second, {r('sum(a * b) / count(*)', 'jaccard')} FROM s GROUP BY ALL""")
def universe_overlap(spark, d):
    return rounded(universe.overlap(event_runs(spark, d, DEPTH), "value", "mix", K_C))


@query(f"WITH {sql.universe(K_C)}, deep AS ({'WITH ' + sql.runs(DEPTH)} SELECT * FROM ru) SELECT query_id, doc_id, system, rank FROM deep WHERE rank <= 30 AND (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM un)")
def containment_escapes(spark, d):
    shallow = universe.build(event_runs(spark, d, K_C), K_C)
    return universe.escapes(event_runs(spark, d, DEPTH), shallow, 30)


@query(f"WITH {sql.universe(DEPTH)}, {sql.QRELS} SELECT un.query_id, un.doc_id, relevance, qr.doc_id IS NOT NULL AS judged FROM un LEFT JOIN qr USING (query_id, doc_id)")
def attach_judgments(spark, d):
    return judgments.attach(universe.build(event_runs(spark, d, DEPTH), DEPTH), event_qrels(spark, d)).drop("sources")


@query(f"WITH {sql.universe(DEPTH)}, {sql.QRELS} SELECT un.query_id, count(*) AS n_universe, count(qr.doc_id) AS n_judged, count(*) FILTER ({sql.gain()} > 0) AS n_relevant, {r('count(qr.doc_id) / count(*)', 'judged_share')} FROM un LEFT JOIN qr USING (query_id, doc_id) GROUP BY ALL")
def judgment_coverage(spark, d):
    return rounded(judgments.coverage(universe.build(event_runs(spark, d, DEPTH), DEPTH), event_qrels(spark, d), DCG.gain))


@query(f"WITH {sql.runs(K_C)}, {sql.QRELS}, c AS (SELECT DISTINCT query_id, doc_id FROM ru WHERE system = 'value') SELECT qr.query_id, count(*) AS n_judged, count(*) FILTER (c.doc_id IS NULL) AS n_outside, count(*) FILTER (c.doc_id IS NULL AND {sql.gain()} > 0) AS n_outside_relevant FROM qr LEFT JOIN c ON c.query_id = qr.query_id AND c.doc_id = qr.doc_id GROUP BY ALL")
def judged_non_survivors(spark, d):
    return judgments.judged_outside(event_qrels(spark, d), event_runs(spark, d, K_C).where("system = 'value'"), DCG.gain)


@query(f"""WITH {sql.runs(DEPTH)}, {sql.QRELS}, c AS (SELECT ru.*, k_c FROM ru, (SELECT unnest([10, {K_C}, 50]) AS k_c) WHERE system = 'value' AND rank <= k_c), a AS (SELECT query_id, count(*) FILTER ({sql.gain()} > 0) AS n_all FROM qr GROUP BY ALL)
SELECT c.query_id, CAST(k_c AS BIGINT) AS k_c, count(*) AS n_candidates, count(qr.doc_id) AS n_judged, count(*) FILTER ({sql.gain()} > 0) AS n_relevant, coalesce(max(n_all), 0) AS n_relevant_all, round(CAST(count(*) FILTER ({sql.gain()} > 0) AS DOUBLE) / nullif(max(n_all), 0), 9) + 0.0 AS recall FROM c LEFT JOIN qr ON qr.query_id = c.query_id AND qr.doc_id = c.doc_id LEFT JOIN a ON a.query_id = c.query_id GROUP BY ALL""")
def density(spark, d):
    return rounded(judgments.density(event_runs(spark, d, DEPTH).where("system = 'value'"), event_qrels(spark, d), DCG.gain, [10, K_C, 50]))


_FLOOR = f"{sql.universe(DEPTH)}, fl AS (SELECT un.query_id, un.doc_id, v.score IS NOT NULL AS retrieved, coalesce(v.score, min(v.score) OVER (PARTITION BY un.query_id) - 1, 0.0) AS score FROM un LEFT JOIN (SELECT * FROM ru WHERE system = 'value') v ON v.query_id = un.query_id AND v.doc_id = un.doc_id)"


def _floored(spark, d):
    runs = event_runs(spark, d, DEPTH)
    return universe.floored(runs, "value", universe.build(runs, DEPTH))


@query(f"WITH {_FLOOR} SELECT query_id, doc_id, retrieved, {r('score', 'score')} FROM fl")
def floor_scores(spark, d):
    return rounded(_floored(spark, d).select("query_id", "doc_id", "retrieved", "score"))


@query(f"WITH {_FLOOR} SELECT query_id, count(*) AS n_universe, count(*) FILTER (retrieved) AS n_retrieved, count(*) FILTER (NOT retrieved) AS n_floored, {r('count(*) FILTER (NOT retrieved) / count(*)', 'floored_share')} FROM fl GROUP BY ALL")
def floor_counts(spark, d):
    return rounded(universe.floor_counts(_floored(spark, d)))


@query(f"WITH {_FLOOR} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, {r('score', 'score')} FROM fl")
def stage1_over_universe(spark, d):
    return rounded(universe.stage1_table(_floored(spark, d), "value", "v1").select("query_id", "doc_id", "rank", "score"))


@query("SELECT CAST(0 AS BIGINT) AS top_k_disagreements, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, CAST(0 AS BIGINT) AS floors_out_of_order")
def stage1_mismatches(spark, d):
    runs = event_runs(spark, d, DEPTH)
    uni = universe.build(runs, DEPTH)
    return universe.table_mismatches(universe.stage1_table(_floored(spark, d), "value", "v1"), runs.where("system = 'value'"), uni, [K_C, 30])


# Score store


def _scores(spark, d):
    """Versions of scores: a first one of half the pairs, then a second one that replaces some."""
    c = event_cascade(spark, d).withColumn("n", F.substring("doc_id", 2, 7).cast("long"))
    one = c.where("n % 2 = 0").select("query_id", "doc_id", F.lit("m").alias("model"), F.col("s2").alias("score"), F.lit(1).alias("version"))
    two = c.where("n % 6 = 0").select("query_id", "doc_id", F.lit("m").alias("model"), (F.col("s2") + 1).alias("score"), F.lit(2).alias("version"))
    return c, one.unionByName(two)


_HELD = f"{sql.events()}, sc AS (SELECT query_id, doc_id, CASE WHEN CAST(substr(doc_id, 2) AS BIGINT) % 6 = 0 THEN s2 + 1 ELSE s2 END AS score FROM ev WHERE CAST(substr(doc_id, 2) AS BIGINT) % 2 = 0)"


@query(f"WITH {_HELD} SELECT query_id, doc_id, 'm' AS model, {r('score', 'score')} FROM sc")
def cache_upsert(spark, d):
    return rounded(score_store.latest(_scores(spark, d)[1]))


@query(f"WITH {_HELD} SELECT query_id, doc_id FROM ev WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM sc)")
def cache_missing(spark, d):
    pairs, rows = _scores(spark, d)
    return score_store.missing(pairs, score_store.latest(rows), "m")


@query(f"WITH {_HELD} SELECT ev.query_id, count(*) AS n_universe, count(sc.doc_id) AS n_scored, count(*) - count(sc.doc_id) AS n_missing FROM ev LEFT JOIN sc ON sc.query_id = ev.query_id AND sc.doc_id = ev.doc_id GROUP BY ALL")
def cache_coverage(spark, d):
    pairs, rows = _scores(spark, d)
    return score_store.coverage(pairs, score_store.latest(rows), "m")


# Features, baselines, metrics

_FEATURES = f"""{sql.worlds()}, c AS (SELECT *, max(CASE WHEN rank_s1 = k_c THEN s1 END) OVER q AS s1_cut, max(CASE WHEN rank_a = {K} THEN s2 END) OVER q AS s2_cut FROM w WINDOW q AS (PARTITION BY query_id)),
fe AS (SELECT query_id, doc_id, in_cq AS survivor, ln(CAST(rank_s1 AS DOUBLE)) AS s1_log_rank, s1 - s1_cut AS s1_margin, CAST(rank_s1 > {DEPTH} AS DOUBLE) AS s1_floored, ln(CAST(alt_rank AS DOUBLE)) AS alt_log_rank, CAST(alt_rank <= k_c AS DOUBLE) AS alt_top_kc, CAST(alt_rank > {DEPTH} AS DOUBLE) AS alt_floored,
 CASE WHEN in_cq THEN s2 END AS s2_score, CAST(rank_a AS DOUBLE) AS s2_rank, CASE WHEN in_cq THEN s2 - s2_cut END AS s2_margin_k, CAST(rank_s1 - rank_a AS DOUBLE) AS displacement FROM c)"""


@query(f"WITH {_FEATURES} SELECT query_id, doc_id, survivor, {', '.join(r(c, c) for c in features.SURVIVOR)} FROM fe")
def features_wide(spark, d):
    return rounded(features.wide(_worlds(spark, d), K, DEPTH).drop("k_c"))


@query(f"WITH {_FEATURES} SELECT query_id, doc_id, feature_name, round(value, 9) + 0.0 AS value FROM (UNPIVOT (SELECT query_id, doc_id, {', '.join(features.SURVIVOR)} FROM fe) ON {', '.join(features.SURVIVOR)} INTO NAME feature_name VALUE value)")
def features_long(spark, d):
    return rounded(features.long(features.wide(_worlds(spark, d), K, DEPTH)).select("query_id", "doc_id", "feature_name", "value"))


@query(f"WITH {sql.worlds()} SELECT query_id, doc_id, {r('s2', 's2')}, {r('(s2 - min(s2) OVER q) / greatest(max(s2) OVER q - min(s2) OVER q, 1e-12)', 's2_norm')} FROM w WHERE in_cq WINDOW q AS (PARTITION BY query_id)")
def stage2_norms(spark, d):
    return rounded(features.stage2_norms(_worlds(spark, d)).drop("k_c"))


@query("WITH p AS (SELECT source AS query_id, doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) AS words FROM documents) SELECT query_id, doc_id, CAST(words AS BIGINT) AS words, round(words / avg(words) OVER (PARTITION BY query_id), 9) + 0.0 AS relative_words FROM p")
def passage_lengths(spark, d):
    return rounded(features.passage_lengths(table(spark, d, "documents").withColumn("query_id", F.col("source"))))


@query(f"WITH {sql.stage(DCG)} SELECT query_id, doc_id, effect_type, CAST(0 AS DOUBLE) AS pred_zero, CASE stratum WHEN 'survivor' THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END AS pred_membership FROM st")
def baseline_membership(spark, d):
    return features.membership(_stage(spark, d)).select("query_id", "doc_id", "effect_type", "pred_zero", "pred_membership")


_TRAIN = "query_id < 'q10'"
_MEANS = f"{sql.stage(DCG)}, tm AS (SELECT effect_type, stratum, avg(effect) AS m FROM st WHERE {_TRAIN} GROUP BY ALL), tp AS (SELECT st.*, CASE WHEN st.effect_type = 'e_rerank' AND st.stratum = 'non_survivor' THEN 0.0 ELSE m END AS pred FROM st JOIN tm USING (effect_type, stratum) WHERE query_id >= 'q10')"


def _predicted(spark, d):
    stage = _stage(spark, d)
    return features.stratum_means(stage.where(_TRAIN), stage.where(f"not ({_TRAIN})"))


@query(f"WITH {_MEANS} SELECT query_id, doc_id, effect_type, {r('pred', 'pred_stratum_mean')} FROM tp")
def baseline_stratum_mean(spark, d):
    return rounded(_predicted(spark, d).select("query_id", "doc_id", "effect_type", "pred_stratum_mean"))


_RANKS = "rank() OVER (PARTITION BY stratum ORDER BY {0}) + (count(*) OVER (PARTITION BY stratum, {0}) - 1) / 2.0"


@query(f"""WITH {sql.stage(DCG)}, g AS (SELECT stratum, -CAST(rank_control AS DOUBLE) AS p, effect AS x FROM st WHERE effect_type = 'e_gate' AND judged), k AS (SELECT *, {_RANKS.format('p')} AS pr, {_RANKS.format('x')} AS xr FROM g)
SELECT stratum, count(*) AS n, {r('avg(abs(p - x))', 'mae')}, {r('sqrt(avg((p - x) * (p - x)))', 'rmse')}, {r('avg(p - x)', 'signed_bias')}, {r('corr(p, x)', 'pearson')}, {r('corr(pr, xr)', 'spearman')} FROM k GROUP BY ALL""")
def metrics_within_strata(spark, d):
    rows = _stage(spark, d).where("effect_type = 'e_gate' and judged").withColumn("p", -F.col("rank_control").cast("double"))
    return rounded(S.point_metrics(rows, "p", "effect", ["stratum"]))


@query(f"""WITH {sql.stage(DCG)}, g AS (SELECT 'all' AS stratum, CASE stratum WHEN 'survivor' THEN 1.0 ELSE -1.0 END AS p, effect AS x FROM st WHERE effect_type = 'e_gate' AND judged), k AS (SELECT *, {_RANKS.format('p')} AS pr, {_RANKS.format('x')} AS xr FROM g) SELECT count(*) AS n, {r('corr(pr, xr)', 'spearman')} FROM k""")
def spearman_pooled(spark, d):
    rows = features.membership(_stage(spark, d).where("effect_type = 'e_gate' and judged")).withColumn("pool", F.lit("all"))
    return rounded(S.point_metrics(rows, "pred_membership", "effect", ["pool"]).select("n", "spearman"))


@query(f"""WITH {sql.stage(DCG)}, g AS (SELECT stratum, query_id, doc_id, row_number() OVER (PARTITION BY stratum ORDER BY abs(1.0 / rank_control) DESC, query_id, doc_id) AS pp, row_number() OVER (PARTITION BY stratum ORDER BY abs(effect) DESC, query_id, doc_id) AS rp FROM st WHERE effect_type = 'e_gate' AND judged)
SELECT stratum, count(*) FILTER (pp <= 20 AND rp <= 20) AS hits, count(*) FILTER (rp <= 20) AS m, {r('count(*) FILTER (pp <= 20 AND rp <= 20) / count(*) FILTER (rp <= 20)', 'top_m_recovery')} FROM g GROUP BY ALL""")
def top_m_recovery(spark, d):
    rows = _stage(spark, d).where("effect_type = 'e_gate' and judged").withColumn("p", F.lit(1.0) / F.col("rank_control"))
    return rounded(S.top_m_recovery(rows, "p", "effect", ["stratum"], 20, ["query_id", "doc_id"]))


@query(f"""WITH {sql.events()}, e AS (SELECT list_distinct(list_transform(range(0, 6), lambda i: i)) AS z), q AS (SELECT [quantile_cont(s1, 0.0), quantile_cont(s1, 0.2), quantile_cont(s1, 0.4), quantile_cont(s1, 0.6), quantile_cont(s1, 0.8), quantile_cont(s1, 1.0)] AS edges FROM ev), b AS (SELECT s1, s2, len(list_filter(edges[2:5], lambda x: x < s1)) AS bin FROM ev, q)
SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n, {r('avg(s1)', 'mean_reference')}, {r('avg(s2)', 'mean_predicted')} FROM b GROUP BY ALL""")
def calibration(spark, d):
    return rounded(S.calibration(event_cascade(spark, d), "s2", "s1", 5))


# Probes


def _probe_x(policy: str, budgets=(0, 5, 20, 50)) -> str:
    order = {N.ALTERNATIVE: "alt_rank", N.RANDOM: "md5('{seed}/' || query_id || '/' || doc_id)"}
    place = "rank_s1 - k_c" if policy == N.BOUNDARY else f"row_number() OVER (PARTITION BY query_id, in_cq ORDER BY {order[policy]}, doc_id)"
    return f"""p AS (SELECT *, {place} AS place FROM w), c AS (SELECT * FROM p, (SELECT unnest([{', '.join(map(str, budgets))}]) AS budget) WHERE in_cq OR place <= budget),
x0 AS (SELECT *, row_number() OVER (PARTITION BY query_id, budget ORDER BY rank_s2) AS rank_p FROM c), x AS (SELECT query_id, doc_id, CAST(budget AS BIGINT) AS budget, NOT in_cq AS probed, {sql.utility('rank_a', DCG)} - {sql.utility('rank_p', DCG)} AS effect FROM x0)"""


_NO_SPREAD = "count(*) >= 3 AND stddev_pop(hr) * stddev_pop(gr) > 1e-18"
_QUERY_LEVEL = f"""h AS (SELECT query_id, budget, -sum(effect) AS g_hat, count(*) FILTER (probed) AS calls FROM x GROUP BY ALL), b0 AS (SELECT h.*, g_q, g_hat > 0.05 AND g_hat > r_q AS said, label = 'gate_sensitive' AS so, round(g_hat, 9) + 0.0 AS hh, round(g_q, 9) + 0.0 AS gg FROM h JOIN dg USING (query_id)),
b1 AS (SELECT *, rank() OVER (PARTITION BY budget ORDER BY hh) + (count(*) OVER (PARTITION BY budget, hh) - 1) / 2.0 AS hr, rank() OVER (PARTITION BY budget ORDER BY gg) + (count(*) OVER (PARTITION BY budget, gg) - 1) / 2.0 AS gr FROM b0),
b2 AS (SELECT budget, count(*) AS n_queries, avg(calls) AS calls_per_query, avg(abs(g_hat - g_q)) AS gq_mae, avg(g_hat) AS g_hat_mean, CASE WHEN {_NO_SPREAD} THEN corr(hr, gr) END AS gq_spearman, count(*) FILTER (said AND so) AS tp, count(*) FILTER (said AND NOT so) AS fp, count(*) FILTER (so AND NOT said) AS fn FROM b1 GROUP BY ALL),
ql AS (SELECT budget, n_queries, {r('calls_per_query', 'calls_per_query')}, {r('gq_mae', 'gq_mae')}, {r('g_hat_mean', 'g_hat_mean')}, {r('gq_spearman', 'gq_spearman')}, tp, fp, fn, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 9) + 0.0 AS "precision", round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 9) + 0.0 AS recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 9) + 0.0 AS f1_or_null FROM b2),
qf AS (SELECT * EXCLUDE (f1_or_null), CASE WHEN tp = 0 THEN 0.0 ELSE f1_or_null END AS f1 FROM ql)"""
_FOUND = f"""fo AS (SELECT g.query_id, g.doc_id, g.effect AS lost, b.budget, x.doc_id IS NOT NULL AS seen FROM gf g CROSS JOIN (SELECT DISTINCT budget FROM x) b LEFT JOIN (SELECT * FROM x WHERE effect < -1e-12) x ON x.query_id = g.query_id AND x.doc_id = g.doc_id AND x.budget = b.budget),
ff AS (SELECT budget, count(*) AS failures, count(*) FILTER (seen) AS found, round(sum(CASE WHEN seen THEN lost ELSE 0.0 END) / nullif(sum(lost), 0), 9) + 0.0 AS loss_recovered_share FROM fo GROUP BY ALL)"""


for _p in (N.BOUNDARY, N.ALTERNATIVE):
    query(f"WITH {sql.worlds()}, {_probe_x(_p)} SELECT query_id, doc_id, budget, probed, {r('effect', 'effect')} FROM x", f"probe_{_p}")(lambda spark, d, p=_p: rounded(probes.probe(_worlds(spark, d), [0, 5, 20, 50], p, DCG).select("query_id", "doc_id", "budget", "probed", "effect")))


@query(f"WITH {sql.stage(DCG)}, {sql.DIAGNOSIS}, {_probe_x(N.ALTERNATIVE)}, {_QUERY_LEVEL} SELECT * FROM qf")
def probe_fidelity(spark, d):
    probed = probes.probe(_worlds(spark, d), [0, 5, 20, 50], N.ALTERNATIVE, DCG)
    return rounded(probes.query_fidelity(probed, summaries.diagnose(_stage(spark, d))))


@query(f"WITH {sql.stage(DCG)}, {sql.FAILURES}, {_probe_x(N.ALTERNATIVE)}, {_FOUND} SELECT * FROM ff")
def probe_failures(spark, d):
    probed = probes.probe(_worlds(spark, d), [0, 5, 20, 50], N.ALTERNATIVE, DCG)
    return rounded(probes.failures_found(probed, effects.gating_failures(_stage(spark, d))))


@query(f"WITH {sql.stage(DCG)} SELECT query_id, doc_id, {r('effect', 'e_gate')} FROM st WHERE effect_type = 'e_gate'")
def probe_everything(spark, d):
    """A probe of every outsider is the world without a gate: its effects are those of the gate."""
    return rounded(probes.full_probe(_worlds(spark, d), DCG).select("query_id", "doc_id", F.col("effect").alias("e_gate")))


_DRAWN = _probe_x(N.RANDOM, (0, 5, 20))
_BY_SEED = " UNION ALL ".join(f"(WITH {sql.stage(DCG)}, {sql.DIAGNOSIS}, {_DRAWN.replace('{seed}', str(s))}, {_QUERY_LEVEL} SELECT CAST({s} AS INT) AS seed, * FROM qf)" for s in (42, 43))


@query(_BY_SEED)
def probe_random(spark, d):
    probed = probes.probe(_worlds(spark, d), [0, 5, 20], N.RANDOM, DCG, seeds=(42, 43))
    return rounded(probes.query_fidelity(probed, summaries.diagnose(_stage(spark, d))))


# Resampling and models


_STEPS = resample.poisson_steps()
_TABLE = f"{_BOTH}, {sql.DIAGNOSIS}, bo AS (SELECT query_id, policy, t, sum(effect) AS delta FROM bg GROUP BY ALL), bt AS (SELECT bo.*, label, g_q, {sql.average_rank('g_q', 'policy, t')} AS gr, {sql.average_rank('delta', 'policy, t')} AS dr FROM bo JOIN dg USING (query_id))"
_GROUP = "CASE WHEN gn >= 2 AND rn >= 2 THEN gs / gn - rs / rn END"
_GROUP_SUMS = "sum(w) AS n, sum(w * delta) AS delta, sum(w) FILTER (label = 'gate_sensitive') AS gn, sum(w * delta) FILTER (label = 'gate_sensitive') AS gs, sum(w) FILTER (label = 'rerank_sensitive') AS rn, sum(w * delta) FILTER (label = 'rerank_sensitive') AS rs, sum(w * gr) AS x, sum(w * dr) AS y, sum(w * gr * gr) AS xx, sum(w * dr * dr) AS yy, sum(w * gr * dr) AS xy"
_RHO = sql.correlation("n", "x", "y", "xx", "yy", "xy")


@query(
    f"""WITH {_TABLE}, pt AS (SELECT policy, t, {_GROUP_SUMS} FROM (SELECT *, 1 AS w FROM bt) GROUP BY ALL), sn AS (SELECT policy, t, gn, rn, gs + rs AS pooled, {_GROUP} AS seen FROM pt WHERE gn >= 2 AND rn >= 2),
mx AS (SELECT bt.policy, bt.t, draw, delta, gn, rn, pooled, seen, row_number() OVER (PARTITION BY bt.policy, bt.t, draw ORDER BY CAST('0x' || substr(md5('42/' || draw || '/' || query_id), 1, 15) AS BIGINT), query_id) AS place FROM bt JOIN sn ON sn.policy = bt.policy AND sn.t = bt.t, (SELECT unnest(range(1, 1001)) AS draw) WHERE label IN ('gate_sensitive', 'rerank_sensitive')),
pm AS (SELECT policy, t, draw, coalesce(sum(delta) FILTER (place <= gn), 0) AS gate, max(gn) AS gn, max(rn) AS rn, max(pooled) AS pooled, max(seen) AS seen FROM mx GROUP BY ALL),
pv AS (SELECT policy, t, (count(*) FILTER (abs(gate / gn - (pooled - gate) / rn) >= abs(seen) - 1e-9) + 1) / 1001 AS p FROM pm GROUP BY ALL)
SELECT pt.policy, pt.t, CAST(n AS BIGINT) AS n_queries, CAST(coalesce(gn, 0) AS BIGINT) AS n_gate_sensitive, CAST(coalesce(rn, 0) AS BIGINT) AS n_rerank_sensitive, {r(_GROUP, 'difference')}, {r('p', 'p_value')}, {r(_RHO, 'rho')} FROM pt LEFT JOIN pv ON pv.policy = pt.policy AND pv.t = pt.t"""
)
def h7_test(spark, d):
    return rounded(resample.h7_permutations(summaries.diagnose(_stage(spark, d)), summaries.budget_outcomes(_budget(spark, d)), permutations=1000))


_INTERVAL = f"statistic, {r('point', 'point')}, {r('lo', 'lo')}, {r('hi', 'hi')}, n_draws"


@query(
    f"""WITH {_TABLE}, dr AS (SELECT *, {sql.weight(_STEPS)} AS w FROM bt, (SELECT unnest(range(0, 201)) AS draw)), ds AS (SELECT policy, t, draw, {_GROUP_SUMS} FROM dr WHERE w > 0 GROUP BY ALL)
SELECT policy, t, {_INTERVAL} FROM ({sql.intervals('ds', 'policy, t', {'delta_mean': 'delta / n', 'group_difference': _GROUP, 'spearman': _RHO})})"""
)
def bootstrap_intervals(spark, d):
    both = summaries.budget_outcomes(_budget(spark, d)).join(summaries.diagnose(_stage(spark, d)).select("query_id", "label", "g_q"), "query_id")
    keys = ["policy", "t"]
    return rounded(resample.replicate_intervals(resample.group_sums(both, keys), keys, resample.GROUPS, resample.GROUP_SUMS, draws=200))


_HASH = "CAST('0x' || substr(md5('42/' || {0}), 1, 15) AS BIGINT)"


@query(
    f"""WITH {_TABLE}, pz AS (SELECT label, delta, row_number() OVER (ORDER BY query_id) - 1 AS pos, count(*) OVER () AS pool FROM bt WHERE policy = 'alternative' AND t = 0.5), sl AS (SELECT size, sim, unnest(range(1, size + 1)) AS slot FROM (SELECT unnest([5, 10, 20]) AS size), (SELECT unnest(range(1, 51)) AS sim)),
dw AS (SELECT sl.*, label = 'gate_sensitive' AS g, delta FROM sl JOIN pz ON pos = {_HASH.format("size || '/' || sim || '/' || slot")} % pool WHERE label IN ('gate_sensitive', 'rerank_sensitive')),
ab AS (SELECT size, sim, count(*) FILTER (g) AS gn, count(*) FILTER (NOT g) AS rn, sum(delta) AS pooled, sum(delta) FILTER (g) / count(*) FILTER (g) - sum(delta) FILTER (NOT g) / count(*) FILTER (NOT g) AS seen FROM dw GROUP BY ALL HAVING count(*) FILTER (g) >= 2 AND count(*) FILTER (NOT g) >= 2),
mp AS (SELECT size, sim, draw, delta, gn, rn, pooled, seen, row_number() OVER (PARTITION BY size, sim, draw ORDER BY {_HASH.format("size || '/' || sim || '/' || draw || '/' || slot")}, slot) AS place FROM dw JOIN ab USING (size, sim), (SELECT unnest(range(1, 201)) AS draw)),
mg AS (SELECT size, sim, draw, sum(delta) FILTER (place <= gn) AS gate, gn, rn, pooled, seen FROM mp GROUP BY ALL), pv AS (SELECT size, sim, (count(*) FILTER (abs(gate / gn - (pooled - gate) / rn) >= abs(seen) - 1e-9) + 1) / 201 AS p FROM mg GROUP BY ALL),
fd AS (SELECT size, count(p) AS testable, count(*) FILTER (p < 0.05) AS found FROM (SELECT unnest([5, 10, 20]) AS size) LEFT JOIN pv USING (size) GROUP BY ALL)
SELECT CAST(size AS BIGINT) AS size, CAST(50 AS BIGINT) AS simulations, testable, {r('found / 50', 'power')}, {r('found / nullif(testable, 0)', 'power_if_testable')}, found / 50 >= 0.8 AS meets_target FROM fd"""
)
def power(spark, d):
    both = summaries.budget_outcomes(_budget(spark, d, policies=(N.ALTERNATIVE,))).where("t = 0.5").join(summaries.diagnose(_stage(spark, d)).select("query_id", "label"), "query_id")
    return rounded(resample.power(both, [5, 10, 20], simulations=50, permutations=200))


def _model(spark, d, kind):
    w = _worlds(spark, d)
    own = effects.stage_effects(w, DCG).where("effect_type = 'e_gate' and stratum = 'survivor' and judged").withColumn("k_c", F.col("k_c").cast("int"))
    rows = features.attach(own, features.wide(w, K, DEPTH))
    got = features.fit_predict(rows.where(_TRAIN), rows.where(f"not ({_TRAIN})"), features.SURVIVOR, kind)
    return got.select("query_id", "doc_id", F.round("effect", 6).alias("effect"), F.round("prediction", 6).alias("prediction"))


@query()
def ridge_predictor(spark, d):
    return _model(spark, d, "ridge")


@query()
def gbt_predictor(spark, d):
    return _model(spark, d, "boosted")


# Retrievers


@query("""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT 'q' || lpad(CAST(q.vec_id AS VARCHAR), 9, '0') AS query_id, 'd' || lpad(CAST(e.vec_id AS VARCHAR), 9, '0') AS doc_id, list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) AS score FROM embeddings e, q WHERE e.vec_id <> q.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, rank, round(score, 6) AS score FROM k WHERE rank <= 100""")
def dense_topk(spark, d):
    """Every fiftieth vector against all others: one more than asked for is searched, the query itself taken out."""
    v = table(spark, d, "embeddings")

    def named(letter: str):
        return F.concat(F.lit(letter), F.lpad(F.col("vec_id").cast("string"), 9, "0"))

    got = retrieval.exact_search(v.where("vec_id % 50 = 0").select(named("q").alias("query_id"), F.col("embedding").alias("vector")), v.select(named("d").alias("doc_id"), F.col("embedding").alias("vector")), 101)
    others = ranking.top_k(got.where("substring(query_id, 2) <> substring(doc_id, 2)").drop("rank"), "score", 100)
    return others.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"""WITH v AS (SELECT 'b' || CAST(item_id AS VARCHAR) AS query_id, unnest(string_split(text, ' ')) AS token FROM benchmark), vq AS (SELECT DISTINCT * FROM v WHERE token <> ''), p0 AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), ' ')) AS token FROM documents), p AS (SELECT * FROM p0 WHERE token <> ''),
l AS (SELECT d.doc_id, count(p.token) AS dl FROM documents d LEFT JOIN p USING (doc_id) GROUP BY ALL), a AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l), tf AS (SELECT token, doc_id, count(*) AS tf FROM p WHERE token IN (SELECT token FROM vq) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY ALL),
s AS (SELECT query_id, tf.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (1 - 0.4 + 0.4 * dl / avgdl))), 6) AS score FROM vq JOIN tf ON tf.token = vq.token JOIN df ON df.token = tf.token JOIN l ON l.doc_id = tf.doc_id CROSS JOIN a GROUP BY ALL)
SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 50""")
def bm25_topk(spark, d):
    queries = table(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("query_id"), "text")
    return retrieval.bm25_search(queries, table(spark, d, "documents").select("doc_id", "text"), 50).select("query_id", "doc_id", "score")


# The whole grid and its reports

_SMALL_GRID = Settings(candidate_depths=(K_C, 30), depth_m=60, k=K, other_cutoffs=(5,), other_utilities=("topk",), budget_seeds=(42, 43))


_GRID_KEY = ["utility", "k", "effect_type", "k_c", "condensed", "policy", "t", "stratum"]


def _totals(rows):
    return rounded(rows.groupBy(*_GRID_KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("effect").alias("total")))


@query()
def effect_grid(spark, d):
    return _totals(grid.effect_grid(event_cascade(spark, d), _SMALL_GRID, "value"))


_PLACED_GRID = replace(_SMALL_GRID, policies=(N.BOUNDARY, N.ALTERNATIVE))


def _grid_totals(u: Utility) -> str:
    """Totals of all grid cells at one utility."""
    group = "count(*) AS n, round(sum(effect), 9) + 0.0 AS total"
    setting = f"'{u.kind}' AS utility, CAST({u.k} AS BIGINT) AS k"
    stages = f"SELECT {setting}, effect_type, CAST(k_c AS BIGINT) AS k_c, condensed, CAST(NULL AS VARCHAR) AS policy, CAST(NULL AS DOUBLE) AS t, stratum, {group} FROM st GROUP BY ALL"
    spends = f"SELECT {setting}, 'delta_t' AS effect_type, CAST(k_c AS BIGINT) AS k_c, condensed, policy, t, stratum, {group} FROM (SELECT *, {sql.utility('rank_t', u)} - {sql.utility('rank_1', u)} AS effect FROM sp) GROUP BY ALL"
    depths, both = _PLACED_GRID.candidate_depths, (False, True)
    return f"(WITH {sql.stage(u, depths, both)} {stages}) UNION ALL (WITH {sql.spent(_PLACED_GRID.policies, sql.T_GRID, depths, both)} {spends})"


@query(" UNION ALL ".join(_grid_totals(Utility(u, k)) for u, k in _PLACED_GRID.settings()))
def effect_grid_placed(spark, d):
    """The grid of the policies that take outsiders by place: every depth, share, mode and utility."""
    return _totals(grid.effect_grid(event_cascade(spark, d), _PLACED_GRID, "value"))


@query(
    f"WITH {sql.allocated((N.BOUNDARY,))} SELECT query_id, t, CAST(seed AS BIGINT) AS seed, max(n_cand) AS n_cand, max(n_out) AS n_out, count(*) FILTER (stratum = 'retained') AS retained, count(*) FILTER (stratum = 'removed') AS removed, count(*) FILTER (stratum = 'selected_outsider') AS selected, count(*) FILTER (stratum = 'unselected_outsider') AS unselected, true AS valid FROM ta, (SELECT unnest([42, 43, 44]) AS seed) GROUP BY ALL"
)
def random_allocation_audit(spark, d):
    """Whom the random policy takes depends on the seed, how many it takes does not."""
    audit = allocation.audit(_allocated(spark, d, (N.RANDOM,), (42, 43, 44)))
    return rounded(audit.select("query_id", "t", "seed", "n_cand", "n_out", "retained", "removed", "selected", "unselected", "valid"))


# Contracts that planted faults break


def _rules(source: str, rules: dict[str, str], kind: str) -> str:
    return " UNION ALL ".join(f"SELECT '{kind}' AS kind, '{name}' AS rule, ({counted if counted.startswith('SELECT') else f'SELECT count(*) FILTER ({counted}) FROM {source}'}) AS n" for name, counted in rules.items())


def _repeated(source: str, keys: str) -> str:
    return f"SELECT count(*) FROM (SELECT {keys} FROM {source} GROUP BY ALL HAVING count(*) > 1)"


_BROKEN_RUN = {
    "rank below 1": "rank < 1", "score missing": "score IS NULL", "null doc_id": "doc_id IS NULL", "repeated key": _repeated("bp", "query_id, doc_id, system"),
    "ranks with gaps": "SELECT count(*) FROM (SELECT query_id, system FROM bp GROUP BY ALL HAVING min(rank) <> 1 OR max(rank) <> count(DISTINCT rank))",
}
_BROKEN_QRELS = {"judged without grade": "judged AND relevance IS NULL", "grade without judgment": "NOT judged AND relevance IS NOT NULL"}
_BROKEN_EFFECTS = {"unknown stratum": "stratum = 'elsewhere'", "definition": "abs(effect - (utility_treatment - utility_control)) > 1e-9", "repeated key": _repeated("be", "query_id, doc_id, effect_type")}


@query(
    f"""WITH {sql.runs(DEPTH)}, bq AS (SELECT query_id, CASE WHEN rank % 19 = 2 THEN NULL ELSE doc_id END AS doc_id, system, CASE WHEN rank % 13 = 6 THEN 0 ELSE rank END AS rank, CASE WHEN rank % 7 <> 3 AND rank % 17 <> 1 THEN score END AS score, rank % 11 = 5 AS twice FROM ru), bp AS (SELECT * FROM bq UNION ALL SELECT * FROM bq WHERE twice),
bj AS (SELECT CASE WHEN relevance <> 1 THEN relevance END AS relevance, relevance <> 3 AS judged FROM ev WHERE judged), x AS (SELECT * FROM ({_rules('bp', _BROKEN_RUN, 'run')} UNION ALL {_rules('bj', _BROKEN_QRELS, 'qrels')}))
SELECT * FROM x WHERE n > 0 UNION ALL (WITH {sql.stage(DCG)}, bs AS (SELECT * REPLACE (CASE WHEN rank_treatment = 1 THEN 'elsewhere' ELSE stratum END AS stratum, CASE WHEN rank_control = 2 THEN effect + 0.5 ELSE effect END AS effect) FROM st), be AS (SELECT * FROM bs UNION ALL SELECT * FROM bs WHERE rank_treatment = 3) SELECT * FROM ({_rules('be', _BROKEN_EFFECTS, 'effect')}) WHERE n > 0)"""
)
def contract_faults(spark, d):
    """Rules that runs, judgments and effects with planted faults break, and how often."""
    rank, twice = F.col("rank"), F.col("rank") % 11 == 5
    score = F.when(rank % 7 == 3, F.lit(None)).when(rank % 17 == 1, float("nan")).otherwise(F.col("score"))
    broken = {"score": score, "doc_id": F.when(rank % 19 != 2, F.col("doc_id")), "rank": F.when(rank % 13 == 6, 0).otherwise(rank), "_twice": twice}
    run = event_runs(spark, d, DEPTH).withColumns(broken)
    qrels = event_qrels(spark, d).withColumns({"relevance": F.when(F.col("relevance") != 1, F.col("relevance")), "judged": F.col("relevance") != 3})
    first, second = F.col("rank_treatment") == 1, F.col("rank_control") == 2
    moved = {"stratum": F.when(first, "elsewhere").otherwise(F.col("stratum")), "effect": F.when(second, F.col("effect") + 0.5).otherwise(F.col("effect"))}
    stage = _stage(spark, d).withColumns(moved)
    tables = {"run": run.unionByName(run.where("_twice")), "qrels": qrels, "effect": stage.unionByName(stage.where("rank_treatment = 3"))}
    counted = [contracts.faults(contracts.coerce(df, kind), kind).select(F.lit(kind).alias("kind"), "rule", "n") for kind, df in tables.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).where("n > 0")


@query(f"WITH {sql.allocated((N.BOUNDARY,))} SELECT query_id, t, doc_id, row_number() OVER (PARTITION BY query_id, t ORDER BY rank_s1) AS promoted_rank FROM ta WHERE stratum = 'selected_outsider'")
def promoted_outsiders(spark, d):
    return rounded(grid.promoted(_allocated(spark, d, (N.BOUNDARY,))).select("query_id", "t", "doc_id", "promoted_rank"))


@query(f"""WITH {sql.runs(DEPTH)}, x AS (SELECT query_id, k_c, doc_id, max(CASE WHEN system = 'value' THEN 1 ELSE 0 END) AS a, max(CASE WHEN system = 'mix' THEN 1 ELSE 0 END) AS b FROM ru, (SELECT unnest([10, {K_C}, 50]) AS k_c) WHERE rank <= k_c GROUP BY ALL)
SELECT query_id, CAST(k_c AS BIGINT) AS k_c, CAST(sum(a * b) AS BIGINT) AS n_both, count(*) AS n_either, {r('sum(a * b) / count(*)', 'jaccard')} FROM x GROUP BY ALL""")
def leverage(spark, d):
    return rounded(feasibility.leverage(event_runs(spark, d, DEPTH), ["value", "mix"], [10, K_C, 50]))


@query(
    f"""WITH {sql.runs(DEPTH)}, {sql.QRELS}, kk AS (SELECT unnest([10, {K_C}, 50]) AS k_c), x AS (SELECT query_id, k_c, doc_id, max(CASE WHEN system = 'value' THEN 1 ELSE 0 END) AS a, max(CASE WHEN system = 'mix' THEN 1 ELSE 0 END) AS b FROM ru, kk WHERE rank <= k_c GROUP BY ALL), j AS (SELECT query_id, k_c, sum(a * b) / count(*) AS jaccard FROM x GROUP BY ALL), lv AS (SELECT k_c, median(jaccard) AS median_jaccard FROM j GROUP BY ALL),
o AS (SELECT s.system, kk.k_c, qr.query_id, count(*) FILTER (ru.doc_id IS NULL AND {sql.gain()} > 0) AS n FROM qr CROSS JOIN (SELECT unnest(['value', 'mix']) AS system) s CROSS JOIN kk LEFT JOIN ru ON ru.query_id = qr.query_id AND ru.doc_id = qr.doc_id AND ru.system = s.system AND ru.rank <= kk.k_c GROUP BY ALL)
SELECT CAST(o.k_c AS BIGINT) AS k_c, system, {r('median(n)', 'median_outside_relevant')}, CAST(sum(n) AS BIGINT) AS outside_relevant, {r('max(median_jaccard)', 'median_jaccard')}, sum(n) >= 5 AND max(median_jaccard) <= 0.9 AS usable FROM o JOIN lv USING (k_c) GROUP BY ALL"""
)
def feasibility_verdict(spark, d):
    runs = event_runs(spark, d, DEPTH)
    lever = feasibility.leverage(runs, ["value", "mix"], [10, K_C, 50])
    return rounded(feasibility.verdict(lever, feasibility.outside(runs, event_qrels(spark, d), DCG.gain, ["value", "mix"], [10, K_C, 50])))


@query(f"""WITH {sql.universe(DEPTH)}, o AS (SELECT un.query_id, un.doc_id, v.rank AS r, m.rank AS o FROM un LEFT JOIN (SELECT * FROM ru WHERE system = 'value') v USING (query_id, doc_id) LEFT JOIN (SELECT * FROM ru WHERE system = 'mix') m USING (query_id, doc_id)),
g AS (SELECT query_id, k_c, count(r) AS ranked, count(o) AS by_other FROM o, (SELECT unnest([10, {K_C}]) AS k_c) WHERE r IS NULL OR r > k_c GROUP BY ALL) SELECT CAST(k_c AS BIGINT) AS k_c, min(ranked) AS least_ranked, {r('median(ranked)', 'median_ranked')}, min(by_other) AS least_by_other, {r('median(by_other)', 'median_by_other')}, CAST(min(CASE WHEN by_other >= k_c THEN 1 ELSE 0 END) AS BIGINT) AS enough FROM g GROUP BY ALL""")
def policy_supply(spark, d):
    runs = event_runs(spark, d, DEPTH)
    return rounded(feasibility.policy_supply(runs, universe.build(runs, DEPTH), "value", "mix", [10, K_C]))


@query(f"WITH {sql.stage(DCG)}, a AS (SELECT query_id, doc_id, max(effect) FILTER (effect_type = 'e_rerank') AS er, max(effect) FILTER (effect_type = 'e_gate') AS eg FROM st GROUP BY ALL) SELECT count(*) AS n, {r('avg(CASE WHEN abs(er) > 1e-9 AND abs(eg) > 1e-9 THEN 1.0 ELSE 0.0 END)', 'share_off_diagonal')} FROM a")
def off_diagonal(spark, d):
    return rounded(reports.off_diagonal(effects.additivity(_stage(spark, d))).drop("max_residual"))


@query(f"WITH {_BOTH}, {sql.DIAGNOSIS}, l AS (SELECT query_id, sum(effect) > 0.05 AS p FROM bg WHERE policy = 'alternative' AND t = 0.5 GROUP BY ALL), j AS (SELECT p, label = 'gate_sensitive' AS y FROM l JOIN dg USING (query_id)) SELECT count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (y AND NOT p) AS fn FROM j")
def label_agreement(spark, d):
    gained = summaries.budget_outcomes(_budget(spark, d, policies=(N.ALTERNATIVE,))).where("t = 0.5").select("query_id", (F.col("delta_dcg") > 0.05).alias("p"))
    both = gained.join(summaries.diagnose(_stage(spark, d)), "query_id").withColumn("y", F.col("label") == N.GATE_SENSITIVE)
    return S.agreement(both, "p", "y").select("tp", "fp", "fn")


@query(f"WITH {sql.events()}, {sql.RANKED} SELECT query_id, doc_id, {r(f'least(1.0, (rank_s1 - 1) / CAST({K_C - 1} AS DOUBLE))', 'rank_share')}, {r('1 - (rank_s1 - 1) / CAST(greatest(n_docs - 1, 1) AS DOUBLE)', 'percentile')}, rank_s1 <= {K_C} AS survivor FROM rk")
def stage1_positions(spark, d):
    return rounded(features.stage1_positions(worlds.ranked(event_cascade(spark, d)), K_C))


_ZERO = "(effect_type = 'e_rerank' AND stratum = 'non_survivor')"


def _fidelity_sql(predicted: str, where: str = "judged") -> str:
    """The whole table of fidelity within strata of one prediction, by plain aggregates."""
    def side(s: str, which: str) -> str:
        x = f"max({which}) FILTER (statistic = '{s}')"
        return r(x if s == "mae" else f"CASE WHEN NOT {_ZERO} THEN {x} END", f"{s}_{which}")

    def informative(x: str, name: str) -> str:
        return r(f"CASE WHEN NOT {_ZERO} THEN {x} END", name)

    k = "effect_type, stratum"
    constant = "stddev_pop({0}) * stddev_pop({1}) > 1e-18"
    pearson, spearman = (f"CASE WHEN {constant.format(a, b)} THEN corr({a}, {b}) END" for a, b in (("p", "x"), ("pr", "xr")))
    return f"""WITH {sql.stage(DCG)}, g AS (SELECT effect_type, stratum, query_id, doc_id, CAST({predicted} AS DOUBLE) AS p, effect AS x FROM st WHERE {where}), {sql.fidelity(_STEPS, 200)},
pt AS (SELECT {k}, count(*) AS n, {r('avg(abs(p - x))', 'mae')}, {informative('sqrt(avg((p - x) * (p - x)))', 'rmse')}, {r('avg(p - x)', 'signed_bias')}, {informative(pearson, 'pearson')}, {informative(spearman, 'spearman')}, count(DISTINCT query_id) AS n_queries, {_ZERO} AS structural_zero, count(*) < 30 AS underpowered FROM kr GROUP BY effect_type, stratum),
bs AS (SELECT {k}, {informative("max(point) FILTER (statistic = 'top_m_recovery')", 'top_m_recovery')}, {', '.join(side(s, w) for s in study.INTERVALS for w in ('lo', 'hi'))} FROM iv GROUP BY effect_type, stratum)
SELECT * FROM pt JOIN bs USING ({k})"""


@query(_fidelity_sql("CASE stratum WHEN 'survivor' THEN 1.0 ELSE -1.0 END"))
def fidelity_within_strata(spark, d):
    return rounded(study.fidelity_within_strata(features.membership(_stage(spark, d)), "pred_membership"))


@query(_fidelity_sql("1.0 / rank_control", "judged AND rank_control IS NOT NULL"))
def fidelity_of_ranks(spark, d):
    """A prediction that varies: the reciprocal rank in the world of comparison."""
    rows = _stage(spark, d).where("rank_control is not null").withColumn("pred_rank", F.lit(1.0) / F.col("rank_control"))
    return rounded(study.fidelity_within_strata(rows, "pred_rank"))


_DIAGNOSED = f"(WITH {{}}, {sql.DIAGNOSIS} SELECT query_id, dcg_actual, g_q, r_q FROM dg)"
_DIFFERENCES = ", ".join(f"a.{c} - b.{c} AS {c}" for c in ("dcg_actual", "g_q", "r_q"))


@query(
    f"""WITH df AS (SELECT query_id, {_DIFFERENCES} FROM {_DIAGNOSED.format(sql.stage(DCG))} a JOIN {_DIAGNOSED.format(sql.stage(DCG, swapped=True))} b USING (query_id)),
dw AS (SELECT *, {sql.weight(_STEPS)} AS w FROM df, (SELECT unnest(range(0, 201)) AS draw)), ds AS (SELECT 1 AS scope, draw, sum(w * dcg_actual) / sum(w) AS dcg_actual, sum(w * g_q) / sum(w) AS g_q, sum(w * r_q) / sum(w) AS r_q FROM dw WHERE w > 0 GROUP BY ALL)
SELECT {_INTERVAL} FROM ({sql.intervals('ds', 'scope', {c: c for c in ('dcg_actual', 'g_q', 'r_q')})})"""
)
def paired_intervals(spark, d):
    return rounded(study.paired_intervals(*(summaries.diagnose(_stage(spark, d, swapped=s)) for s in (False, True)), draws=200))


_COST = " UNION ALL ".join(f"(WITH {sql.stage(DCG)}, {sql.DIAGNOSIS}, {sql.FAILURES.replace('1e-9', '1e-12')}, {_probe_x(p, (0, 20, 50))}, {_QUERY_LEVEL}, {_FOUND} SELECT '{p}' AS policy, qf.*, failures, found, loss_recovered_share FROM qf LEFT JOIN ff USING (budget))" for p in (N.BOUNDARY, N.ALTERNATIVE))


@query(_COST)
def cost_fidelity(spark, d):
    own = _worlds(spark, d)
    stage = effects.stage_effects(own, DCG)
    return rounded(study.cost_fidelity(own, summaries.diagnose(stage), stage, DCG, [0, 20, 50]))


from . import durable, stored  # noqa: E402,F401  (registers its queries with the helpers above)
