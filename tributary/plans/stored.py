"""Registered queries over what is written and read back: contracts, texts, scores, vectors, grids.

Each writes below the session's shared folder and reads its files again, so the rows that come out
have been through the files. The checks of the catalog are held here against planted faults.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config, contracts
from .. import names as N
from ..operators import allocation, effects, features, judgments, probes, summaries, universe, worlds
from ..sources import embeddings, files, retrieval, score_store, trec
from ..sources.tables import scratch, table
from . import grid, reports, sql, study
from .cascades import event_cascade, event_qrels, event_runs, short
from .catalog import _FEATURES, _FLOOR, _HELD, DCG, DEPTH, _allocated, _budget, _floored, _probe_x, _scores, _stage, _worlds, query, rounded
from .sql import K_C, K, r


def _through(spark, df, kind):
    path = scratch(spark, kind)
    contracts.save(df, path, kind)
    return contracts.load(spark, path, kind)


# Contracts


@query(f"WITH {sql.runs(DEPTH)} SELECT query_id, doc_id, system, rank, {r('score', 'score')}, 'v1' AS checkpoint FROM ru")
def contract_run(spark, d):
    return rounded(short(_through(spark, event_runs(spark, d, DEPTH, whole=True), "run")))


@query(f"WITH {sql.universe(DEPTH)} SELECT query_id, doc_id, sources FROM un")
def contract_universe(spark, d):
    return _through(spark, universe.build(event_runs(spark, d, DEPTH), DEPTH), "universe")


@query(f"WITH {sql.events()}, {sql.QRELS} SELECT query_id, doc_id, relevance, true AS judged FROM qr")
def contract_qrels(spark, d):
    return short(_through(spark, event_qrels(spark, d, whole=True), "qrels"))


@query(f"WITH {_HELD} SELECT query_id, doc_id, 'm' AS model, {r('score', 'score')} FROM sc")
def contract_scores(spark, d):
    return rounded(_through(spark, score_store.latest(_scores(spark, d)[1]), "stage2_cache"))


@query(f"WITH {_FEATURES} SELECT query_id, doc_id, feature_name, round(value, 9) + 0.0 AS value FROM (UNPIVOT (SELECT query_id, doc_id, {', '.join(features.SURVIVOR)} FROM fe) ON {', '.join(features.SURVIVOR)} INTO NAME feature_name VALUE value)")
def contract_feature(spark, d):
    long = features.long(features.wide(_worlds(spark, d), K, DEPTH))
    for name, value in (("feature_version", F.lit("v1")), ("generation_seconds", F.lit(0.0))):
        long = long if name in long.columns else long.withColumn(name, value)
    return rounded(_through(spark, long, "feature").select("query_id", "doc_id", "feature_name", "value"))


@query(f"WITH {sql.stage(DCG)} SELECT query_id, doc_id, effect_type, stratum, {r('effect', 'effect')} FROM st")
def contract_effect(spark, d):
    rows = effects.stage_effects(worlds.build_worlds(event_cascade(spark, d, whole=True), [K_C]), DCG)
    return rounded(short(_through(spark, rows, "effect").select("query_id", "doc_id", "effect_type", "stratum", "effect")))


@query(f"WITH {sql.stage(DCG, modes=(False, True))} SELECT query_id, doc_id, effect_type, {r('effect', 'effect')} FROM st WHERE condensed")
def select_mode(spark, d):
    both = contracts.select_mode(_stage(spark, d, modes=(False, True)), True)
    return rounded(contracts.single_mode(both).select("query_id", "doc_id", "effect_type", "effect"))


@query(f"WITH {sql.events()}, {sql.QRELS} SELECT relevance, count(*) AS n FROM qr WHERE relevance NOT IN (0, 2, 3) GROUP BY ALL")
def unmapped_grades(spark, d):
    return judgments.unmapped_grades(event_qrels(spark, d), [0, 2, 3])


# Texts and files


@query(f"WITH {sql.events()}, {sql.QRELS} SELECT query_id, doc_id, relevance, true AS judged FROM qr")
def trec_qrels(spark, d):
    path = scratch(spark, "qrels-text")
    event_qrels(spark, d).select(F.concat_ws(" ", "query_id", F.lit("0"), "doc_id", F.col("relevance").cast("string")).alias("value")).write.text(path)
    return trec.read_qrels(spark, path)


@query("SELECT 'b' || CAST(item_id AS VARCHAR) AS query_id, trim(replace(replace(text, chr(10), ' '), chr(9), ' ')) AS text FROM benchmark")
def trec_queries(spark, d):
    path = scratch(spark, "queries-text")
    line = F.concat(F.lit("b"), F.col("item_id").cast("string"), F.lit("\t"), F.translate("text", "\n\t", "  "))
    table(spark, d, "benchmark").select(line.alias("value")).write.text(path)
    return trec.read_queries(spark, path)


@query(f"WITH {sql.runs(K_C)}, b AS (SELECT 'b' || CAST(item_id AS VARCHAR) AS query_id FROM benchmark), l AS (SELECT DISTINCT 'b' || CAST(doc_id % 40 AS VARCHAR) AS query_id FROM labels) SELECT query_id FROM b SEMI JOIN l USING (query_id)")
def judged_queries(spark, d):
    queries = table(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("query_id"))
    judged = table(spark, d, "labels").select(F.concat(F.lit("b"), (F.col("doc_id") % 40).cast("string")).alias("query_id"))
    return trec.judged_queries(queries, judged)


@query("SELECT doc_id, text FROM documents SEMI JOIN labels USING (doc_id)")
def required_passages(spark, d):
    return trec.passages(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels"))


@query(f"WITH {sql.runs(DEPTH)} SELECT query_id, doc_id, rank, {r('score', 'score')} FROM ru WHERE system = 'mix' AND rank <= {K_C}")
def stored_run(spark, d):
    got = retrieval.stored_run(_through(spark, event_runs(spark, d, DEPTH, whole=True), "run"), "mix", K_C)
    return rounded(short(got).select("query_id", "doc_id", "rank", "score"))


_SHARES = {"train": 0.5, "val": 0.2, "test": 0.3}


@query(
    f"""WITH {sql.events()}, q AS (SELECT DISTINCT query_id FROM ev), o AS (SELECT query_id, row_number() OVER (ORDER BY sha256('42/' || query_id)) - 1 AS place, count(*) OVER () AS n FROM q)
SELECT query_id, CASE WHEN place < floor(0.5 * n + 0.5) THEN 'train' WHEN place < floor(0.7 * n + 0.5) THEN 'val' ELSE 'test' END AS split FROM o"""
)
def query_split(spark, d):
    """One row per query reaches the driver, as a split is a small file."""
    ids = [x.query_id for x in event_cascade(spark, d).select("query_id").distinct().collect()]
    parts = config.split_queries(ids, _SHARES, 42)
    files.check_split(parts, ids)
    return files.split_table(spark, parts)


@query(f"WITH {sql.universe(DEPTH)} SELECT query_id, doc_id, sources FROM un")
def frozen_universe(spark, d):
    path, mark = scratch(spark, "universe"), config.Settings().fingerprint
    files.freeze(universe.build(event_runs(spark, d, DEPTH), DEPTH), path, mark)
    return files.load_frozen(spark, path, mark)


# Scores and vectors


@query(f"WITH {_HELD} SELECT ev.query_id, ev.doc_id, {r('coalesce(sc.score, ev.s1 * 2)', 'score')} FROM ev LEFT JOIN sc ON sc.query_id = ev.query_id AND sc.doc_id = ev.doc_id")
def score_store_filled(spark, d):
    """Two versions are put and the rest is filled by a scorer; the store is complete afterwards."""
    pairs, rows = _scores(spark, d)
    store = score_store.ScoreStore(spark, scratch(spark, "scores"))
    for v in (1, 2):
        store.put(rows.where(F.col("version") == v).drop("version"), v)
    store.fill(pairs, "m", lambda todo: todo.join(pairs.select("query_id", "doc_id", (F.col("s1") * 2).alias("score")), ["query_id", "doc_id"]))
    store.require_complete(pairs, "m")
    return rounded(store.scores("m").select("query_id", "doc_id", "score"))


@query(f"WITH {_HELD} SELECT model, count(*) AS n_scores FROM (SELECT 'm' AS model FROM sc UNION ALL SELECT 'other' FROM sc WHERE query_id = 'q01') GROUP BY ALL")
def score_store_merged(spark, d):
    rows = score_store.latest(_scores(spark, d)[1])
    first, second = (score_store.ScoreStore(spark, scratch(spark, n)) for n in ("scores", "others"))
    first.put(rows, 1)
    second.put(rows.where("query_id = 'q01'").withColumn("model", F.lit("other")), 1)
    first.merge_from(second, "other")
    first.merge_from(second, "other")
    return spark.createDataFrame([(m, first.count(m)) for m in first.models()], "model string, n_scores long")


@query(f"WITH {_HELD}, o AS (SELECT query_id, count(*) AS n_scores FROM sc GROUP BY ALL), e AS (SELECT count(*) AS asked FROM ev), h AS (SELECT count(*) AS held FROM sc) SELECT query_id, n_scores, asked, held AS held_before, asked - held AS scored, CAST(0 AS BIGINT) AS missing FROM o, e, h")
def score_store_report(spark, d):
    """Scored queries before a fill, beside what the fill reports."""
    pairs, rows = _scores(spark, d)
    path = scratch(spark, "scores")
    store = score_store.ScoreStore(spark, path)
    store.put(score_store.latest(rows), 1)
    before = _through(spark, store.scores("m"), "stage2_cache").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_scores"))
    same = before.join(store.queries("m").select("query_id", F.col("n_scores").alias("held")), "query_id").where("held = n_scores").drop("held")
    report = store.fill(pairs, "m", lambda todo: todo.withColumn("score", F.lit(0.0)))
    return same.select("*", *[F.lit(report[k]).cast("long").alias(k) for k in ("asked", "held_before", "scored", "missing")])


@query("SELECT item_id, length(text) AS n, CAST(round(length(text) / sqrt(CAST(length(text) * length(text) + 1 AS DOUBLE)), 5) AS DOUBLE) AS first FROM benchmark")
def vector_shards(spark, d):
    """Vectors of texts by a stand-in encoder, filled twice: the second time finds nothing to do."""
    import numpy as np

    path = scratch(spark, "vectors")
    texts = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("doc_id"), "text")
    for part in (texts.where("doc_id % 2 = 0"), texts, texts):
        embeddings.fill(spark, path, part, lambda ts: np.array([[len(t), 1.0] for t in ts]), shard_rows=1 << 30)
    held = embeddings.check(spark.read.schema(embeddings.SCHEMA).parquet(path))
    both = held.join(texts, "doc_id")
    return both.select(F.col("doc_id").cast("long").alias("item_id"), F.length("text").cast("long").alias("n"), F.round(F.get("vector", F.lit(0)).cast("double"), 5).alias("first"))


@query("SELECT item_id, doc_id, CAST(length(d.text) - length(b.text) AS DOUBLE) AS score FROM benchmark b JOIN documents d ON d.doc_id % 40 = b.item_id % 40")
def pointwise_scores(spark, d):
    pairs = table(spark, d, "benchmark").select("item_id", F.col("text").alias("query"), (F.col("item_id") % 40).alias("m")).join(table(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 40).alias("m")), "m")
    got = reports.scored(pairs.select("item_id", "doc_id", "query", "text"), lambda q, t: t.str.len().astype(float) - q.str.len())
    return got.select("item_id", "doc_id", "score")


# The grid on disk


@query(f"WITH {sql.stage(DCG, (K_C, 30), (False, True))} SELECT query_id, doc_id, effect_type, {r('effect', 'effect')} FROM st WHERE k_c = 30 AND condensed")
def grid_read(spark, d):
    path = scratch(spark, "grid")
    built = worlds.build_worlds(event_cascade(spark, d, whole=True), [K_C, 30], [False, True])
    grid.write_grid(effects.stage_effects(built, DCG), path)
    return rounded(short(grid.read_grid(spark, path, system="s1", k_c=30, kind="stage", condensed=True).select("query_id", "doc_id", "effect_type", "effect")))


@query(f"WITH {sql.allocated((N.BOUNDARY,))} SELECT query_id, t, doc_id, true AS in_first, false AS in_second FROM ta WHERE stratum = 'selected_outsider' AND query_id = 'q01'")
def allocation_differences(spark, d):
    """Two published tables of which one lacks a query."""
    own = grid.promoted(_allocated(spark, d, (N.BOUNDARY,)))
    return grid.allocation_mismatches(own, own.where("query_id <> 'q01'")).select("query_id", "t", "doc_id", "in_first", "in_second")


_TEXTS = "tx AS (SELECT query_id, doc_id, 'text of ' || doc_id AS text FROM ev)"


@query(
    f"""WITH {sql.stage(DCG)}, {sql.FAILURES}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY effect, rank_control, doc_id) AS n FROM gf), o AS (SELECT query_id, doc_id, rank_control, effect FROM f WHERE n = 1 ORDER BY f.effect, rank_control, query_id, doc_id LIMIT 5),
p AS (SELECT query_id, doc_id AS top_doc FROM st WHERE effect_type = 'e_rerank' AND rank_treatment = 1) SELECT query_id, doc_id, top_doc, 'query ' || query_id AS query, 'text of ' || doc_id AS passage, 'text of ' || top_doc AS top_passage, {r('effect', 'effect')} FROM o JOIN p USING (query_id)"""
)
def gating_examples(spark, d):
    c = event_cascade(spark, d)
    queries = c.select("query_id").distinct().withColumn("text", F.concat(F.lit("query "), "query_id"))
    texts = c.select("doc_id", F.concat(F.lit("text of "), "doc_id").alias("text"))
    got = reports.gating_examples(_stage(spark, d), queries, texts, 5)
    return rounded(got.select("query_id", "doc_id", "top_doc", "query", "passage", "top_passage", "effect"))


# Planted faults: what the checks are for


def _every(n: int, doc: str = "doc_id"):
    return F.substring(doc, 2, 7).cast("long") % n == 0


def _sql_every(n: int, doc: str = "doc_id") -> str:
    return f"CAST(substr({doc}, 2) AS BIGINT) % {n} = 0"


@query(
    f"""WITH {sql.worlds()}, x AS (SELECT query_id, rank_a, CASE WHEN NOT {_sql_every(11)} THEN rank_b END AS rank_b, CASE WHEN {_sql_every(13)} THEN 1 ELSE rank_c END AS rank_c FROM w),
g AS (SELECT query_id, count(*) FILTER ((rank_a IS NULL) <> (rank_b IS NULL)) AS a_not_b, count(rank_c) - count(DISTINCT rank_c) AS repeated_c FROM x GROUP BY ALL) SELECT * FROM g WHERE a_not_b + repeated_c > 0"""
)
def isolation_violations_planted(spark, d):
    w = _worlds(spark, d)
    w = w.withColumn("rank_b", F.when(~_every(11), F.col("rank_b"))).withColumn("rank_c", F.when(_every(13), 1).otherwise(F.col("rank_c")))
    return rounded(worlds.isolation_violations(w).select("query_id", "a_not_b", "repeated_c"))


@query(
    f"""WITH {sql.stage(DCG)}, x AS (SELECT effect_type, CASE WHEN {_sql_every(7)} THEN 'elsewhere' ELSE stratum END AS s, utility_treatment - utility_control AS was, effect + CASE WHEN {_sql_every(5)} THEN 1 WHEN {_sql_every(6)} THEN -2 ELSE 0 END AS e FROM st)
SELECT effect_type, count(*) AS n, count(*) FILTER (abs(e - was) > 1e-9) AS definition, count(*) FILTER (s = 'elsewhere') AS unknown_stratum, count(*) FILTER (effect_type = 'e_rerank' AND s = 'non_survivor' AND abs(e) > 1e-9) AS structural_zero,
count(*) FILTER (effect_type = 'e_gate' AND ((s = 'survivor' AND e < -1e-9) OR (s = 'non_survivor' AND e > 1e-9))) AS gate_sign FROM x GROUP BY ALL"""
)
def invariant_violations_planted(spark, d):
    st = _stage(spark, d).withColumn("stratum", F.when(_every(7), "elsewhere").otherwise(F.col("stratum")))
    st = st.withColumn("effect", F.col("effect") + F.when(_every(5), 1).when(_every(6), -2).otherwise(0))
    return effects.violations(st, DCG.monotone).select("effect_type", "n", "definition", "unknown_stratum", "structural_zero", "gate_sign")


@query(
    f"""WITH {sql.budget(DCG)}, x AS (SELECT stratum AS s, effect + CASE WHEN {_sql_every(5)} THEN 1 WHEN {_sql_every(6)} THEN -1 ELSE 0 END AS e FROM bg) SELECT 'delta_t' AS effect_type, count(*) AS n, count(*) FILTER ((s = 'removed' AND e > 1e-9) OR (s = 'selected_outsider' AND e < -1e-9)) AS budget_sign FROM x"""
)
def budget_violations_planted(spark, d):
    bg = _budget(spark, d).withColumn("effect", F.col("effect") + F.when(_every(5), 1).when(_every(6), -1).otherwise(0))
    return effects.violations(bg, DCG.monotone).select("effect_type", "n", "budget_sign")


@query(
    f"""WITH {sql.allocated()}, x AS (SELECT *, CASE WHEN {_sql_every(9)} AND stratum = 'selected_outsider' THEN 'unselected_outsider' WHEN {_sql_every(10)} AND stratum = 'retained' THEN 'removed' ELSE stratum END AS s FROM ta),
g AS (SELECT query_id, policy, t, max(n_cand) AS n_cand, max(n_out) AS n_out, count(*) FILTER (s = 'retained') AS retained, count(*) FILTER (s = 'removed') AS removed, count(*) FILTER (s = 'selected_outsider') AS selected, count(*) FILTER (s = 'unselected_outsider') AS unselected FROM x GROUP BY ALL)
SELECT query_id, policy, t, retained, selected, retained = least(n_cand, retained + removed) AND selected = least(n_out, selected + unselected) AS valid FROM g"""
)
def allocation_audit_planted(spark, d):
    ta = _allocated(spark, d)
    ta = ta.withColumn("stratum", F.when(_every(9) & (F.col("stratum") == N.SELECTED), N.UNSELECTED).when(_every(10) & (F.col("stratum") == N.RETAINED), N.REMOVED).otherwise(F.col("stratum")))
    return rounded(allocation.audit(ta).select("query_id", "policy", "t", "retained", "selected", "valid"))


@query(
    f"""WITH {_FLOOR}, t0 AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, CASE WHEN retrieved OR NOT {_sql_every(4)} THEN score ELSE score + 1e6 END AS score FROM fl),
tb AS (SELECT query_id, doc_id, CASE WHEN rank <= 2 THEN 3 - rank ELSE rank END AS rank, score FROM t0 WHERE NOT {_sql_every(17)} UNION ALL SELECT DISTINCT query_id, 'extra', 999999, -1e9 FROM ev), v AS (SELECT * FROM ru WHERE system = 'value')
SELECT (SELECT count(*) FROM tb JOIN v USING (query_id, rank) WHERE rank <= 30 AND tb.doc_id <> v.doc_id) AS top_k_disagreements, (SELECT count(*) FROM un WHERE {_sql_every(17, 'un.doc_id')}) AS missing, (SELECT count(DISTINCT query_id) FROM ev) AS extra,
(SELECT count(*) FROM (SELECT tb.query_id, max(tb.score) FILTER (v.doc_id IS NULL) AS hi, min(tb.score) FILTER (v.doc_id IS NOT NULL) AS lo FROM tb LEFT JOIN v ON v.query_id = tb.query_id AND v.doc_id = tb.doc_id GROUP BY ALL) WHERE hi >= lo) AS floors_out_of_order"""
)
def stage1_mismatches_planted(spark, d):
    """The best two swapped, documents dropped and added, and floored ones lifted over retrieved ones."""
    runs = event_runs(spark, d, DEPTH)
    own = universe.stage1_table(_floored(spark, d), "value", "v1").join(_floored(spark, d).select("query_id", "doc_id", "retrieved"), ["query_id", "doc_id"])
    own = own.withColumn("score", F.when(F.col("retrieved") | ~_every(4), F.col("score")).otherwise(F.col("score") + 1e6)).withColumn("rank", F.when(F.col("rank") <= 2, 3 - F.col("rank")).otherwise(F.col("rank")))
    extra = runs.select("query_id").distinct().select("query_id", F.lit("extra").alias("doc_id"), F.lit("value").alias("system"), F.lit(999999).cast("long").alias("rank"), F.lit(-1e9).alias("score"), F.lit("v1").alias("checkpoint"))
    planted = own.where(~_every(17)).select(*extra.columns).unionByName(extra)
    return universe.table_mismatches(planted, runs.where("system = 'value'"), universe.build(runs, DEPTH), [K_C, 30])


# Baselines and convergence

_CLEAN = "FROM st WHERE effect_type = 'e_gate' AND judged"


@query(
    f"""WITH {sql.stage(DCG)}, z AS (SELECT stratum, 'zero' AS baseline, 0.0 AS p, effect AS x {_CLEAN} UNION ALL SELECT stratum, 'membership', CASE stratum WHEN 'survivor' THEN 1.0 ELSE -1.0 END, effect {_CLEAN})
SELECT baseline, stratum, count(*) AS n, {r('avg(abs(p - x))', 'mae')}, {r('sqrt(avg((p - x) * (p - x)))', 'rmse')}, {r('avg(p - x)', 'signed_bias')} FROM z GROUP BY ALL"""
)
def baseline_report(spark, d):
    rows = features.membership(_stage(spark, d).where("effect_type = 'e_gate' and judged"))
    return rounded(study.baseline_report(rows.withColumn("pred_zero", F.lit(0.0)), {"zero": "pred_zero", "membership": "pred_membership"}).select("baseline", "stratum", "n", "mae", "rmse", "signed_bias"))


@query(f"WITH {sql.budget(DCG)} SELECT policy, t, stratum, count(*) AS n, {r('avg(effect)', 'mean')}, count(*) FILTER (effect > 1e-9) AS n_gained, count(*) FILTER (effect < -1e-9) AS n_lost FROM bg GROUP BY ALL")
def budget_stratum_report(spark, d):
    return rounded(study.budget_stratum_report(_budget(spark, d)))


@query(
    f"""WITH {sql.stage(DCG)}, {sql.DIAGNOSIS}, {_probe_x(N.BOUNDARY, (0, 5, 20, 50))}, h AS (SELECT query_id, budget, -sum(effect) AS g_hat FROM x GROUP BY ALL), b AS (SELECT budget, avg(abs(g_hat - g_q)) AS mae FROM h JOIN dg USING (query_id) GROUP BY ALL)
SELECT budget, {r('mae', 'gq_mae')}, {r('mae - lag(mae) OVER (ORDER BY budget)', 'change')} FROM b"""
)
def convergence(spark, d):
    own = _worlds(spark, d)
    curve = probes.query_fidelity(probes.probe(own, [0, 5, 20, 50], N.BOUNDARY, DCG), summaries.diagnose(effects.stage_effects(own, DCG)))
    return rounded(study.convergence(curve, "gq_mae"))
