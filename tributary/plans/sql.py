"""Independent SQL for the catalog's queries: common table expressions over the data tables."""

from __future__ import annotations

from ..functions.utility import GAINS, Utility

K_C, K = 20, 10
T_GRID = (1.0, 0.9, 0.75, 0.5)


def r(x: str, name: str) -> str:
    return f"round({x}, 9) + 0.0 AS {name}"


def events(swapped: bool = False) -> str:
    own, other = "CAST(value AS DOUBLE)", "CAST((event_id * 104729) % 10009 AS DOUBLE)"
    s1, alt = (other, own) if swapped else (own, other)
    return f"""ev AS (SELECT 'q' || lpad(CAST(user_id % 20 AS VARCHAR), 2, '0') AS query_id, 'd' || lpad(CAST(event_id AS VARCHAR), 7, '0') AS doc_id,
 {s1} AS s1, CAST((event_id * 7919) % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE) AS s2, {alt} AS alt_score,
 CAST(CASE WHEN event_id % 3 <> 0 THEN CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END END AS BIGINT) AS relevance, event_id % 3 <> 0 AS judged FROM events)"""


RANKED = """rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s1 DESC, doc_id) AS rank_s1, row_number() OVER (PARTITION BY query_id ORDER BY s2 DESC, doc_id) AS rank_s2,
 row_number() OVER (PARTITION BY query_id ORDER BY alt_score DESC, doc_id) AS alt_rank, count(*) OVER (PARTITION BY query_id) AS n_docs FROM ev)"""


def worlds(depths=(K_C,), modes=(False,), swapped: bool = False) -> str:
    flags = ", ".join(str(m).lower() for m in modes)
    return f"""{events(swapped)}, {RANKED}, wd AS (SELECT *, rank_s1 <= k_c AS in_cq FROM rk, (SELECT unnest([{', '.join(map(str, depths))}]) AS k_c), (SELECT unnest([{flags}]) AS condensed) WHERE NOT condensed OR judged),
w AS (SELECT *, CASE WHEN in_cq THEN row_number() OVER (PARTITION BY query_id, k_c, condensed, in_cq ORDER BY rank_s2) END AS rank_a, CASE WHEN in_cq THEN row_number() OVER (PARTITION BY query_id, k_c, condensed, in_cq ORDER BY rank_s1) END AS rank_b,
 row_number() OVER (PARTITION BY query_id, k_c, condensed ORDER BY rank_s2) AS rank_c FROM wd)"""


def gain(column: str = "relevance") -> str:
    return f"(CASE {' '.join(f'WHEN {column} = {g} THEN CAST({v} AS DOUBLE)' for g, v in GAINS.items())} ELSE CAST(0 AS DOUBLE) END)"


def utility(rank: str, u: Utility) -> str:
    worth = f"(CASE WHEN {gain()} > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)" if u.kind == "topk" else f"{gain()} * ([{', '.join(map(repr, u.discounts()))}])[{rank}]"
    return f"(CASE WHEN {rank} BETWEEN 1 AND {u.k} THEN {worth} ELSE CAST(0 AS DOUBLE) END)"


def stage(u: Utility, depths=(K_C,), modes=(False,), swapped: bool = False) -> str:
    return f"""{worlds(depths, modes, swapped)}, wu AS (SELECT *, CASE WHEN in_cq THEN 'survivor' ELSE 'non_survivor' END AS stratum, {utility('rank_a', u)} AS u_a, {utility('rank_b', u)} AS u_b, {utility('rank_c', u)} AS u_c FROM w),
st AS (SELECT query_id, doc_id, k_c, condensed, judged, relevance, stratum, 'e_rerank' AS effect_type, rank_a AS rank_treatment, rank_b AS rank_control, u_a AS utility_treatment, u_b AS utility_control, u_a - u_b AS effect FROM wu
 UNION ALL SELECT query_id, doc_id, k_c, condensed, judged, relevance, stratum, 'e_gate', rank_a, rank_c, u_a, u_c, u_a - u_c FROM wu)"""


def allocated(policies=("boundary", "alternative"), t_grid=T_GRID, k_c: int = K_C) -> str:
    ts = ", ".join(f"CAST({t} AS DOUBLE)" for t in t_grid)
    ps = ", ".join(f"'{p}'" for p in policies)
    return f"""{worlds((k_c,))}, pl AS (SELECT *, rank_s1 - k_c AS place_boundary, row_number() OVER (PARTITION BY query_id, in_cq ORDER BY alt_rank, doc_id) AS place_alternative FROM w),
al AS (SELECT *, CAST(floor(t * {k_c}) AS BIGINT) AS n_cand, {k_c} - CAST(floor(t * {k_c}) AS BIGINT) AS n_out FROM pl, (SELECT unnest([{ts}]) AS t), (SELECT unnest([{ps}]) AS policy)),
sa AS (SELECT *, CASE WHEN in_cq AND rank_s1 <= n_cand THEN 'retained' WHEN in_cq THEN 'removed' WHEN (CASE policy WHEN 'boundary' THEN place_boundary ELSE place_alternative END) <= n_out THEN 'selected_outsider' ELSE 'unselected_outsider' END AS stratum FROM al),
ta AS (SELECT *, stratum IN ('retained', 'selected_outsider') AS submitted, CASE WHEN stratum IN ('retained', 'selected_outsider') THEN row_number() OVER (PARTITION BY query_id, t, policy, stratum IN ('retained', 'selected_outsider') ORDER BY rank_s2) END AS rank_t FROM sa)"""


def budget(u: Utility, policies=("boundary", "alternative"), t_grid=T_GRID) -> str:
    return f"""{allocated(policies, t_grid)}, bs AS (SELECT query_id, doc_id, policy, rank_t AS rank_1 FROM ta WHERE t = 1.0),
bu AS (SELECT ta.*, rank_1, {utility('rank_t', u)} AS utility_treatment, {utility('rank_1', u)} AS utility_control FROM ta JOIN bs USING (query_id, doc_id, policy) WHERE t <> 1.0),
bg AS (SELECT *, utility_treatment - utility_control AS effect, 'delta_t' AS effect_type FROM bu)"""


def spent(policies: tuple[str, ...], t_grid: tuple[float, ...], depths: tuple[int, ...], modes: tuple[bool, ...]) -> str:
    """Allocations at several depths, ranked in each mode: sp, with rank_t and rank_1. Places of outsiders are
    those among all documents."""
    ts = ", ".join(f"CAST({t} AS DOUBLE)" for t in t_grid)
    ps = ", ".join(f"'{p}'" for p in policies)
    return f"""{worlds(depths, modes)}, wf AS (SELECT query_id, doc_id, k_c, rank_s1 - k_c AS boundary, row_number() OVER (PARTITION BY query_id, k_c, in_cq ORDER BY alt_rank, doc_id) AS alternative FROM (SELECT *, rank_s1 <= k_c AS in_cq FROM rk, (SELECT unnest([{', '.join(map(str, depths))}]) AS k_c))),
ac AS (SELECT w.*, t, policy, CASE policy WHEN 'boundary' THEN boundary ELSE alternative END AS place, CAST(floor(t * k_c) AS BIGINT) AS n_cand FROM w JOIN wf USING (query_id, doc_id, k_c), (SELECT unnest([{ts}]) AS t), (SELECT unnest([{ps}]) AS policy)),
ad AS (SELECT *, CASE WHEN in_cq AND rank_s1 <= n_cand THEN 'retained' WHEN in_cq THEN 'removed' WHEN place <= k_c - n_cand THEN 'selected_outsider' ELSE 'unselected_outsider' END AS stratum FROM ac),
ae AS (SELECT *, CASE WHEN stratum IN ('retained', 'selected_outsider') THEN row_number() OVER (PARTITION BY query_id, k_c, condensed, t, policy, stratum IN ('retained', 'selected_outsider') ORDER BY rank_s2) END AS rank_t FROM ad),
sp AS (SELECT ae.*, rank_1 FROM ae JOIN (SELECT query_id, doc_id, k_c, condensed, policy, rank_t AS rank_1 FROM ae WHERE t = 1.0) USING (query_id, doc_id, k_c, condensed, policy) WHERE t <> 1.0)"""


DIAGNOSIS = """dg0 AS (SELECT query_id, k_c, condensed, sum(CASE WHEN effect_type = 'e_rerank' THEN utility_treatment ELSE 0.0 END) AS dcg_actual, -sum(CASE WHEN effect_type = 'e_gate' THEN effect ELSE 0.0 END) AS g_q, sum(CASE WHEN effect_type = 'e_rerank' THEN effect ELSE 0.0 END) AS rerank_signed FROM st GROUP BY ALL),
dg AS (SELECT *, abs(rerank_signed) AS r_q, rerank_signed < 0 AS reranker_harms, CASE WHEN g_q > 0.05 AND g_q > abs(rerank_signed) THEN 'gate_sensitive' WHEN abs(rerank_signed) > 0.05 AND abs(rerank_signed) >= greatest(g_q, 0.0) THEN 'rerank_sensitive' ELSE 'mixed_stable' END AS label FROM dg0)"""

FAILURES = "gf AS (SELECT * FROM st WHERE effect_type = 'e_gate' AND stratum = 'non_survivor' AND utility_control > 1e-9)"


def runs(depth: int) -> str:
    return f"""{events()}, ru AS (SELECT * FROM (SELECT query_id, doc_id, 'value' AS system, row_number() OVER (PARTITION BY query_id ORDER BY s1 DESC, doc_id) AS rank, s1 AS score FROM ev UNION ALL
 SELECT query_id, doc_id, 'mix', row_number() OVER (PARTITION BY query_id ORDER BY alt_score DESC, doc_id), alt_score FROM ev) WHERE rank <= {depth})"""


QRELS = "qr AS (SELECT query_id, doc_id, relevance FROM ev WHERE judged)"


def universe(depth: int) -> str:
    return f"{runs(depth)}, un AS (SELECT query_id, doc_id, string_agg(DISTINCT system, ',' ORDER BY system) AS sources, min(rank) AS best_rank FROM ru GROUP BY ALL)"


def weight(steps: list[int], seed: int = 42) -> str:
    """The weight of ``query_id`` in ``draw``."""
    return f"(CASE WHEN draw = 0 THEN 1 ELSE len(list_filter([{', '.join(map(str, steps))}], lambda s: CAST('0x' || substr(md5('{seed}/' || draw || '/' || query_id), 1, 8) AS BIGINT) >= s)) END)"


def correlation(n: str, x: str, y: str, xx: str, yy: str, xy: str) -> str:
    vx, vy = f"({n} * {xx} - {x} * {x})", f"({n} * {yy} - {y} * {y})"
    return f"CASE WHEN {n} >= 3 AND {vx} > 1e-9 AND {vy} > 1e-9 THEN ({n} * {xy} - {x} * {y}) / sqrt({vx}) / sqrt({vy}) END"


def average_rank(column: str, keys: str) -> str:
    return f"rank() OVER (PARTITION BY {keys} ORDER BY {column}) + (count(*) OVER (PARTITION BY {keys}, {column}) - 1) / 2.0"


def intervals(source: str, keys: str, statistics: dict[str, str], alpha: float = 0.05) -> str:
    """(keys, statistic, point, lo, hi, n_draws) of ``source(keys, draw, statistics...)``."""
    each = " UNION ALL ".join(f"SELECT {keys}, draw, '{n}' AS statistic, CAST({x} AS DOUBLE) AS v FROM {source}" for n, x in statistics.items())
    return f"SELECT {keys}, statistic, max(v) FILTER (draw = 0) AS point, quantile_cont(v, {alpha / 2}) FILTER (draw > 0) AS lo, quantile_cont(v, {1 - alpha / 2}) FILTER (draw > 0) AS hi, count(v) FILTER (draw > 0) AS n_draws FROM ({each}) GROUP BY ALL"


def fidelity(steps: list[int], draws: int, m: int = 20) -> str:
    """Replicates of the metrics of ``g(effect_type, stratum, query_id, doc_id, p, x)``: iv, one row per statistic."""
    k = "effect_type, stratum"
    sums = {"n": "1.0", "ab": "abs(p - x)", "sq": "(p - x) * (p - x)", "rx": "pr", "ry": "xr", "rxx": "pr * pr", "ryy": "xr * xr", "rxy": "pr * xr"}
    weighted = ", ".join(f"sum(w * {c}) AS {c}" for c in sums)
    stats = {"mae": "ab / n", "rmse": "sqrt(sq / n)", "spearman": correlation("n", "rx", "ry", "rxx", "ryy", "rxy")}
    return f"""kr AS (SELECT *, {average_rank('p', k)} AS pr, {average_rank('x', k)} AS xr FROM g), ks AS (SELECT {k}, query_id, {', '.join(f'sum({x}) AS {c}' for c, x in sums.items())} FROM kr GROUP BY ALL),
kw AS (SELECT *, {weight(steps)} AS w FROM ks, (SELECT unnest(range(0, {draws + 1})) AS draw)), kd AS (SELECT {k}, draw, {weighted} FROM kw WHERE w > 0 GROUP BY ALL),
tq AS (SELECT query_id, draw FROM (SELECT DISTINCT query_id, draw, {weight(steps)} AS w FROM g, (SELECT unnest(range(0, {draws + 1})) AS draw)) WHERE w > 0),
tp AS (SELECT {k}, draw, row_number() OVER (PARTITION BY {k}, draw ORDER BY abs(p) DESC, query_id, doc_id) AS a, row_number() OVER (PARTITION BY {k}, draw ORDER BY abs(x) DESC, query_id, doc_id) AS b FROM g JOIN tq USING (query_id)),
td AS (SELECT {k}, draw, count(*) FILTER (a <= {m} AND b <= {m}) / count(*) FILTER (b <= {m}) AS top_m_recovery FROM tp GROUP BY ALL),
iv AS ({intervals('kd', k, stats)} UNION ALL {intervals('td', k, {'top_m_recovery': 'top_m_recovery'})})"""
