"""Registered queries over work that is merged, committed in parts, or done again only where it has to be.

Each plants what it is about: conflicts and gaps, a run that is stopped, rows that are lost, a scorer that
looks at its batch.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import names as N
from ..config import Settings
from ..functions import statistics as S
from ..functions.utility import Utility, aggregation_gaps, ndcg, recall
from ..operators import effects, features, probes, resample, rescoring, summaries, universe, worlds
from ..sources import embeddings, shard_merge, vector_format
from ..sources.score_store import ScoreStore, plan_shards, shard_loads
from ..sources.tables import scratch, table
from . import assembly, feasibility, grid, ingest, runner, sql, study
from .cascades import event_cascade, event_qrels, event_runs, short
from .catalog import DCG, DEPTH, ORACLES, _allocated, _budget, _probe_x, _stage, _worlds, query, rounded
from .sql import K_C, K, r

OWNERS = ("a", "b", "c")


def _number(doc: str = "doc_id"):
    return F.substring(doc, 2, 7).cast("long")


# Merging shard stores: every third document is an owner's; each seventh and eleventh also the next owner's,
# the eleventh with another score; each thirteenth is nobody's; the first owner scored documents nobody asked for.


def _shards(spark, d) -> tuple[dict[str, ScoreStore], DataFrame]:
    own = event_cascade(spark, d).select("query_id", "doc_id", F.round("s2", 6).alias("score"), _number().alias("n")).where("n % 13 <> 0")
    again = own.where("n % 7 = 0 or n % 11 = 0").select("query_id", "doc_id", F.when(F.col("n") % 11 == 0, F.col("score") + 1).otherwise(F.col("score")).alias("score"), (F.col("n") + 1).alias("n"))
    strays = own.where("n % 17 = 0").select("query_id", F.concat(F.lit("x"), "doc_id").alias("doc_id"), "score", F.lit(0).cast("long").alias("n"))
    stores = {}
    for i, owner in enumerate(OWNERS):
        stores[owner] = ScoreStore(spark, scratch(spark, f"shard-{owner}"))
        stores[owner].put(own.unionByName(again).unionByName(strays).where(F.col("n") % 3 == i).select("query_id", "doc_id", F.lit("m").alias("model"), "score"), version=1)
    return stores, event_cascade(spark, d).select("query_id", "doc_id")


_SHARDS = f"""{sql.events()}, nu AS (SELECT query_id, doc_id, round(s2, 6) AS score, CAST(substr(doc_id, 2) AS BIGINT) AS n FROM ev), ow AS (SELECT * FROM nu WHERE n % 13 <> 0),
sh AS (SELECT query_id, doc_id, score, n % 3 AS o FROM ow UNION ALL SELECT query_id, doc_id, CASE WHEN n % 11 = 0 THEN score + 1 ELSE score END, (n + 1) % 3 FROM ow WHERE n % 7 = 0 OR n % 11 = 0 UNION ALL SELECT query_id, 'x' || doc_id, score, 0 FROM ow WHERE n % 17 = 0),
pa AS (SELECT coalesce(nu.query_id, sh.query_id) AS query_id, coalesce(nu.doc_id, sh.doc_id) AS doc_id, count(DISTINCT o) AS n_owners, min(sh.score) AS lowest, max(sh.score) AS highest, min_by(sh.score, o) AS first, count(nu.doc_id) > 0 AS asked FROM nu FULL JOIN sh ON sh.query_id = nu.query_id AND sh.doc_id = nu.doc_id GROUP BY ALL),
st2 AS (SELECT *, CASE WHEN NOT asked THEN 'stray' WHEN n_owners = 0 THEN 'gap' WHEN highest > lowest THEN 'conflict' WHEN n_owners > 1 THEN 'repeated' ELSE 'single' END AS status FROM pa)"""


@query(f"WITH {_SHARDS} SELECT query_id, doc_id, status, n_owners, {r('lowest', 'lowest')}, {r('highest', 'highest')} FROM st2")
def shard_pairs(spark, d):
    """What three shards and the universe say of every pair."""
    stores, universe = _shards(spark, d)
    pairs = shard_merge.reconcile(shard_merge.labelled(stores, "m"), universe)
    return rounded(pairs.select("query_id", "doc_id", "status", F.size("owners").cast("long").alias("n_owners"), "lowest", "highest"))


@query(f"WITH {_SHARDS} SELECT query_id, count(*) AS asked, count(*) FILTER (status <> 'gap') AS held, count(*) FILTER (status = 'gap') AS gap, count(*) FILTER (status = 'conflict') AS conflict FROM st2 WHERE status <> 'stray' GROUP BY ALL")
def shard_gaps(spark, d):
    stores, universe = _shards(spark, d)
    return shard_merge.by_query(shard_merge.reconcile(shard_merge.labelled(stores, "m"), universe))


@query(f"WITH {_SHARDS} SELECT query_id, doc_id, {r('first', 'score')} FROM st2 WHERE status NOT IN ('gap', 'stray')")
def shard_merged(spark, d):
    """The scores of a committed merge in which the owner named first settles conflicts."""
    stores, universe = _shards(spark, d)
    path = scratch(spark, "merged")
    shard_merge.merge(spark, path, stores, "m", universe, on_conflict="first", allow_gaps=True)
    return rounded(shard_merge.merged_scores(spark, path, "m").select("query_id", "doc_id", "score"))


@query(
    f"""WITH {_SHARDS}, ea AS (SELECT o, status FROM st2 JOIN sh ON sh.query_id = st2.query_id AND sh.doc_id = st2.doc_id), q AS (SELECT count(*) FILTER (status <> 'stray') AS asked, count(*) FILTER (status = 'gap') AS missing, count(*) FILTER (status = 'conflict') AS conflicts FROM st2)
SELECT ['a', 'b', 'c'][o + 1] AS owner, count(*) AS rows, count(*) FILTER (status = 'single') AS single, count(*) FILTER (status = 'repeated') AS repeated, count(*) FILTER (status = 'conflict') AS conflict, count(*) FILTER (status = 'stray') AS stray, asked, asked - missing AS merged, missing, conflicts, true AS found_again FROM ea, q GROUP BY ALL"""
)
def shard_manifest(spark, d):
    """The committed manifest by owner; the second merge of the same shards finds it."""
    stores, universe = _shards(spark, d)
    path = scratch(spark, "merged")
    first, second = (shard_merge.merge(spark, path, stores, "m", universe, on_conflict="first", allow_gaps=True) for _ in range(2))
    rows = [(o, *(x[c] for c in ("rows", "single", "repeated", "conflict", "stray")), *(first[c] for c in ("asked", "merged", "missing", "conflicts")), first == second) for o, x in first["owners"].items()]
    return spark.createDataFrame(rows, "owner string, rows long, single long, repeated long, conflict long, stray long, asked long, merged long, missing long, conflicts long, found_again boolean")


# Vectors as float16 shards


@query("SELECT CAST(vec_id AS VARCHAR) AS doc_id, CAST(floor(CAST(embedding[1] AS DOUBLE) * 64) / 64 + 0.0 AS DOUBLE) AS first, CAST(floor(CAST(embedding[8] AS DOUBLE) * 64) / 64 + 0.0 AS DOUBLE) AS eighth, len(embedding) AS n FROM embeddings")
def vector_source(spark, d):
    """Vectors through the shard format and back; multiples of 1/64 are float16 numbers."""
    path = scratch(spark, "vector-shards")
    vector_format.register(spark)
    v = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("doc_id"), F.transform("embedding", lambda x: (F.floor(x.cast("double") * 64) / 64).cast("float")).alias("vector"), (F.col("vec_id") % 7).cast("int").alias("shard"))
    v.repartitionByRange(3, "shard").sortWithinPartitions("shard").write.format(vector_format.FORMAT).mode("append").save(path)
    back = spark.read.format(vector_format.FORMAT).load(path)
    return rounded(back.select("doc_id", F.get("vector", F.lit(0)).cast("double").alias("first"), F.get("vector", F.lit(7)).cast("double").alias("eighth"), F.size("vector").cast("long").alias("n")))


def _one_hot(texts: list[str]) -> np.ndarray:
    """A stand-in encoder whose vectors float16 holds exactly."""
    return np.eye(8)[[len(t) % 8 for t in texts]]


def _one_hot_until(texts: list[str]) -> np.ndarray:
    if any(len(t) % 97 == 0 for t in texts):
        raise RuntimeError("the encoder was stopped")
    return _one_hot(texts)


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, length(coalesce(text, '')) % 8 AS place, CAST(1 AS DOUBLE) AS value FROM documents")
def encode_resumed(spark, d):
    """All texts encoded by a run that was stopped and one that went on."""
    path = scratch(spark, "encoded")
    texts = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    size = max(1, texts.count() // 4)
    try:
        embeddings.encode_shards(spark, path, texts, _one_hot_until, "one-hot", shard_rows=size, wave=2)
    except Exception as e:
        if "the encoder was stopped" not in str(e):
            raise
    embeddings.encode_shards(spark, path, texts, _one_hot, "one-hot", shard_rows=size, wave=2)
    back = spark.read.format(vector_format.FORMAT).load(path)
    return back.select("doc_id", (F.array_position("vector", F.lit(1.0).cast("float")) - 1).alias("place"), F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")).alias("value"))


# The grid in cells

_CELLS = Settings(candidate_depths=(K_C,), depth_m=60, k=K, other_cutoffs=(), other_utilities=("topk",), budget_seeds=(42, 43))
_ONE = Settings(candidate_depths=(K_C,), depth_m=60, k=K, other_cutoffs=(), other_utilities=(), policies=(N.BOUNDARY,))
_N_UTILITIES = len(_CELLS.settings())


def _resumed(spark, d, settings: Settings, last: str) -> str:
    """The grid of a run that was stopped before ``last`` was committed, and of one that went on."""
    path, stored = scratch(spark, "cells"), scratch(spark, "cascade")
    event_cascade(spark, d, whole=True).write.parquet(stored)
    c = spark.read.parquet(stored)

    def stop(name: str) -> None:
        if name == last:
            raise InterruptedError("the run was stopped")

    try:
        grid.write_cells(c, settings, "value", path, before_commit=stop)
    except InterruptedError:
        pass
    grid.write_cells(c, settings, "value", path)
    return path


@query(
    f"""WITH {sql.events()}, x AS (SELECT count(*) + count(*) FILTER (judged) AS n, count(DISTINCT query_id) AS q FROM ev), p AS (SELECT {K_C} AS k_c, NULL AS policy, 0 AS seeds UNION ALL SELECT k_c, policy, CASE policy WHEN 'random' THEN 2 ELSE 1 END FROM (SELECT {K_C} AS k_c), (SELECT unnest(['boundary', 'alternative', 'random']) AS policy))
SELECT 'value-k' || k_c || '-' || coalesce(policy, 'stage') AS cell, CAST(k_c AS BIGINT) AS k_c, policy, CAST(n * {_N_UTILITIES} * CASE WHEN policy IS NULL THEN 2 ELSE 3 * seeds END AS BIGINT) AS rows, CASE WHEN policy IS NOT NULL THEN CAST(q * seeds AS BIGINT) END AS baselines, CASE WHEN policy IS NOT NULL THEN CAST(0 AS BIGINT) END AS baselines_that_differ FROM p, x"""
)
def grid_cells(spark, d):
    """What is committed after a run that was stopped in its third cell and one that went on."""
    return grid.cell_records(spark, _resumed(spark, d, _CELLS, f"value-k{K_C}-{N.ALTERNATIVE}"))


@query(f"WITH {sql.budget(DCG, (N.BOUNDARY,))} SELECT query_id, doc_id, t, stratum, {r('effect', 'effect')} FROM bg")
def grid_cells_read(spark, d):
    rows = grid.read_cells(spark, _resumed(spark, d, _ONE, f"value-k{K_C}-{N.BOUNDARY}"), K_C, N.BOUNDARY).where(f"utility = 'dcg' and k = {K} and not condensed")
    return rounded(short(rows.select("query_id", "doc_id", "t", "stratum", "effect")))


_AGREE = "SELECT policy, count(*) AS runs, count(*) FILTER (wrong_members = 0 AND wrong_ranks = 0) AS agree, CAST(sum(wrong_members) AS BIGINT) AS wrong_members, CAST(sum(wrong_ranks) AS BIGINT) AS wrong_ranks FROM (SELECT policy, query_id, count(*) FILTER (s <> in_cq) AS wrong_members, count(*) FILTER (s AND rt IS DISTINCT FROM rank_a) AS wrong_ranks FROM x WHERE t = 1.0 GROUP BY ALL) GROUP BY ALL"


def _agreement(allocated: DataFrame) -> DataFrame:
    each = worlds.baseline_agreement(allocated)
    return each.groupBy("policy").agg(F.count(F.lit(1)).alias("runs"), F.sum(F.col("agrees").cast("long")).alias("agree"), F.sum("wrong_members").alias("wrong_members"), F.sum("wrong_ranks").alias("wrong_ranks"))


@query(f"WITH {sql.allocated()}, x AS (SELECT policy, query_id, t, in_cq, submitted AS s, rank_t AS rt, rank_a FROM ta) {_AGREE}")
def baseline_agreement(spark, d):
    """The worlds at t = 1 against the cascade as it is."""
    return _agreement(_allocated(spark, d))


@query(f"WITH {sql.allocated()}, x AS (SELECT policy, query_id, t, in_cq, submitted <> (CAST(substr(doc_id, 2) AS BIGINT) % 997 = 0) AS s, CASE WHEN CAST(substr(doc_id, 2) AS BIGINT) % 19 = 0 THEN rank_t + 1 ELSE rank_t END AS rt, rank_a FROM ta) {_AGREE}")
def baseline_agreement_planted(spark, d):
    """Documents that change sides and ranks that are one too high."""
    rows = _allocated(spark, d)
    rows = rows.withColumn("submitted", F.col("submitted") != (_number() % 997 == 0)).withColumn("rank_t", F.when(_number() % 19 == 0, F.col("rank_t") + 1).otherwise(F.col("rank_t")))
    return _agreement(rows)


# Ridge of every stratum from one aggregate

_TWO = ["s1_log_rank", "alt_log_rank"]
_FIT = "query_id < 'q10'"


@query(
    f"""WITH {sql.stage(DCG)}, fx AS (SELECT st.*, ln(CAST(rank_s1 AS DOUBLE)) AS a, ln(CAST(alt_rank AS DOUBLE)) AS b FROM st JOIN (SELECT query_id, doc_id, rank_s1, alt_rank FROM w) USING (query_id, doc_id)),
gs AS (SELECT effect_type, stratum, count(*) AS n, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb, avg(effect) AS my, corr(a, b) AS rab, count(*) * covar_pop(a, effect) / stddev_pop(a) AS ca, count(*) * covar_pop(b, effect) / stddev_pop(b) AS cb FROM fx WHERE {_FIT} AND judged GROUP BY ALL),
so AS (SELECT *, ((n + 1) * ca - n * rab * cb) / ((n + 1) * (n + 1) - n * rab * n * rab) AS wa, ((n + 1) * cb - n * rab * ca) / ((n + 1) * (n + 1) - n * rab * n * rab) AS wb FROM gs)
SELECT query_id, doc_id, fx.effect_type, fx.stratum, round(CASE WHEN fx.effect_type = 'e_rerank' AND fx.stratum = 'non_survivor' THEN 0.0 ELSE my + wa * (a - ma) / sa + wb * (b - mb) / sb END, 6) + 0.0 AS prediction FROM fx JOIN so USING (effect_type, stratum) WHERE query_id >= 'q10'"""
)
def ridge_all_strata(spark, d):
    w = _worlds(spark, d)
    rows = effects.stage_effects(w, DCG).join(features.wide(w, K, DEPTH).select("query_id", "doc_id", *_TWO), ["query_id", "doc_id"])
    got = study.fit_all_strata(rows, {N.SURVIVOR: _TWO, N.NON_SURVIVOR: _TWO}, _FIT)
    return got.select("query_id", "doc_id", "effect_type", "stratum", (F.round("prediction", 6) + F.lit(0.0)).alias("prediction"))


# Assembly: runs lack every eleventh pair, scores have every thirteenth twice and one in 29 that nobody asked for


@query(
    f"""WITH {sql.events()}, nu AS (SELECT query_id, doc_id, CAST(substr(doc_id, 2) AS BIGINT) AS n, judged FROM ev)
SELECT query_id, doc_id, 'runs' AS source, 'lost' AS reason FROM nu WHERE n % 11 = 0 UNION ALL SELECT query_id, doc_id, 'scores', 'doubled' FROM nu WHERE n % 13 = 0 UNION ALL SELECT query_id, 'x' || doc_id, 'scores', 'unasked' FROM nu WHERE n % 29 = 0 UNION ALL SELECT query_id, doc_id, 'universe', 'doubled' FROM nu WHERE n % 31 = 0"""
)
def assembly_reasons(spark, d):
    universe, tables = _tables(spark, d)
    return assembly.reasons(universe, tables, ["runs", "scores"])


def _tables(spark, d) -> tuple[DataFrame, dict[str, DataFrame]]:
    c = event_cascade(spark, d).select("query_id", "doc_id", _number().alias("n"))
    strays = c.where("n % 29 = 0").select("query_id", F.concat(F.lit("x"), "doc_id").alias("doc_id"), "n")
    return c.unionByName(c.where("n % 31 = 0")), {"runs": c.where("n % 11 <> 0"), "scores": c.unionByName(c.where("n % 13 = 0")).unionByName(strays), "qrels": event_qrels(spark, d)}


@query(
    f"""WITH {sql.events()}, nu AS (SELECT query_id, doc_id, CAST(substr(doc_id, 2) AS BIGINT) AS n FROM ev), x AS (SELECT query_id, 'runs' AS source, 'lost' AS reason FROM nu WHERE n % 11 = 0 UNION ALL SELECT query_id, 'scores', 'doubled' FROM nu WHERE n % 13 = 0 UNION ALL SELECT query_id, 'scores', 'unasked' FROM nu WHERE n % 29 = 0 UNION ALL SELECT query_id, 'universe', 'doubled' FROM nu WHERE n % 31 = 0)
SELECT source, reason, count(*) AS pairs, count(DISTINCT query_id) AS queries FROM x GROUP BY ALL"""
)
def assembly_summary(spark, d):
    universe, tables = _tables(spark, d)
    return assembly.summary(assembly.reasons(universe, tables, ["runs", "scores"]))


# Scorers in other company


def _pointwise(query, text):
    return (text.str.len() - query.str.len()).astype(float)


def _peeking(query, text):
    return _pointwise(query, text) + text.str.len().mean()


@query("""WITH p AS (SELECT count(*) AS n FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40) SELECT scorer, n AS n_pairs, scorer = 'pointwise' AS holds FROM p, (SELECT unnest(['pointwise', 'peeking']) AS scorer)""")
def shuffle_invariance(spark, d):
    """Each document with one question: an honest scorer, and one that adds its batch's mean length."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("m"), F.col("text").alias("query"))
    pairs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 40).alias("m")).join(items, "m").select("doc_id", "query", "text")
    each = [rescoring.shuffle_invariance(pairs, ["doc_id"], f, seeds=(1, 2)).select(F.lit(name).alias("scorer"), "n_pairs", "holds") for name, f in (("pointwise", _pointwise), ("peeking", _peeking))]
    return each[0].unionByName(each[1])


@query(
    f"""WITH {sql.worlds()}, u AS (SELECT query_id, sum({sql.utility('rank_c', DCG)}) AS total FROM w GROUP BY ALL), h AS (SELECT query_id, sum({sql.gain()} / log2(CAST(rank_c AS DOUBLE) + 1)) AS dcg FROM w WHERE rank_c <= {K} GROUP BY ALL)
SELECT query_id, {r('total', 'total')}, {r('dcg', 'dcg')}, abs(total - dcg) < 1e-9 AS adds_up FROM u JOIN h USING (query_id)"""
)
def utility_adds_up(spark, d):
    """Utilities of documents in the world without a gate, and the DCG of its ranking."""
    rows = _worlds(spark, d).select("query_id", "doc_id", F.col("rank_c").alias("rank"), "relevance")
    return rounded(aggregation_gaps(rows, DCG).select("query_id", "total", "dcg", (F.col("gap") < N.EPS).alias("adds_up")))


# A study that is run again

_STUDY = Settings(candidate_depths=(K_C,), depth_m=60, k=K, other_cutoffs=(), other_utilities=(), budget_seeds=(42,), policies=(N.BOUNDARY, N.ALTERNATIVE))


def _study(spark, d) -> tuple[runner.Study, dict[str, DataFrame]]:
    path = scratch(spark, "study-effects")
    grid.effect_grid(event_cascade(spark, d), _STUDY, "value", [Utility("dcg", K)], modes=(False,)).write.parquet(path)
    return runner.Study(spark, scratch(spark, "study"), _STUDY, runner.analysis(_STUDY, draws=20, permutations=50)), {"effects": spark.read.parquet(path)}


@query(f"WITH {sql.events()}, q AS (SELECT count(DISTINCT query_id) AS q, count(*) AS n FROM ev) SELECT step, rows, true AS first_run, false AS second_run, step IN ('diagnosis', 'groups', 'test', 'intervals') AS after_change FROM (SELECT unnest(['stage', 'budget', 'diagnosis', 'outcomes', 'groups']) AS step, unnest([2 * n, 6 * n, q, 6 * q, 6]) AS rows FROM q)")
def study_rerun(spark, d):
    """Which steps were worked out: at first all, then none, and with a new diagnosis only what reads it."""
    own, inputs = _study(spark, d)
    first, second = own.run(**inputs), own.run(**inputs)
    changed = runner.Study(spark, own.path, own.settings, [s if s.name != "diagnosis" else runner.Step(s.name, s.reads, lambda st: summaries.diagnose(st, 0.5), 2) for s in own.steps])
    third = changed.run(**inputs)
    rows = [(n, own.table(n).count(), first[n], second[n], third[n]) for n in ("stage", "budget", "diagnosis", "outcomes", "groups")]
    return spark.createDataFrame(rows, "step string, rows long, first_run boolean, second_run boolean, after_change boolean")


@query(f"WITH {sql.stage(DCG)}, {sql.DIAGNOSIS} SELECT query_id, {r('g_q', 'g_q')}, label FROM dg")
def study_diagnosis(spark, d):
    """A table of the study, through its commits."""
    own, inputs = _study(spark, d)
    runner.Study(spark, own.path, own.settings, [s for s in own.steps if s.name in ("stage", "diagnosis")]).run(**inputs)
    return rounded(own.table("diagnosis").select("query_id", "g_q", "label"))


# Findings, outcomes by setting, intervals at the level of queries


@query(
    f"""WITH {sql.universe(DEPTH)}, {sql.QRELS}, kk AS (SELECT unnest([10, {K_C}, 50]) AS k_c), sy AS (SELECT unnest(['value', 'mix']) AS system), x AS (SELECT query_id, k_c, doc_id, max(CASE WHEN system = 'value' THEN 1 ELSE 0 END) AS a, max(CASE WHEN system = 'mix' THEN 1 ELSE 0 END) AS b FROM ru, kk WHERE rank <= k_c GROUP BY ALL), lv AS (SELECT k_c, median(j) AS value FROM (SELECT query_id, k_c, sum(a * b) / count(*) AS j FROM x GROUP BY ALL) GROUP BY ALL),
o AS (SELECT system, k_c, median(n) AS value FROM (SELECT sy.system, kk.k_c, qr.query_id, count(*) FILTER (ru.doc_id IS NULL AND {sql.gain()} > 0) AS n FROM qr CROSS JOIN sy CROSS JOIN kk LEFT JOIN ru ON ru.query_id = qr.query_id AND ru.doc_id = qr.doc_id AND ru.system = sy.system AND ru.rank <= kk.k_c GROUP BY ALL) GROUP BY ALL),
du AS (SELECT un.query_id, count(qr.doc_id) / count(*) AS u FROM un LEFT JOIN qr ON qr.query_id = un.query_id AND qr.doc_id = un.doc_id GROUP BY ALL), dc AS (SELECT ru.system, k_c, ru.query_id, count(qr.doc_id) / count(*) AS c FROM ru JOIN kk ON ru.rank <= kk.k_c LEFT JOIN qr ON qr.query_id = ru.query_id AND qr.doc_id = ru.doc_id GROUP BY ALL), dm AS (SELECT system, k_c, median(c / u) AS ratio, median(c) AS density FROM dc JOIN du USING (query_id) GROUP BY ALL),
f AS (SELECT 'judgment_placement' AS finding, k_c, system, ratio AS value FROM dm WHERE ratio > 1.05 UNION ALL SELECT 'gate_failure_supply', k_c, system, value FROM o WHERE value < 12 UNION ALL SELECT 'between_system_asymmetry', k_c, NULL, max(density) / min(density) FROM dm GROUP BY k_c HAVING max(density) / min(density) > 1.05 UNION ALL SELECT 'no_leverage', k_c, NULL, value FROM lv WHERE value > 0.05 UNION ALL SELECT 'no_usable_depth', NULL, NULL, 0.0 WHERE NOT EXISTS (SELECT k_c FROM o GROUP BY k_c HAVING min(value) >= 12))
SELECT finding, CAST(k_c AS BIGINT) AS k_c, system, {r('value', 'value')} FROM f"""
)
def feasibility_findings(spark, d):
    """Named findings at limits that this small collection reaches."""
    runs, qrels, systems, depths = event_runs(spark, d, DEPTH), event_qrels(spark, d), ["value", "mix"], [10, K_C, 50]
    outs, lever = feasibility.outside(runs, qrels, DCG.gain, systems, depths), feasibility.leverage(runs, systems, depths)
    placed = feasibility.placement(runs, universe.build(runs, DEPTH), qrels, systems, depths)
    return rounded(feasibility.findings(lever, outs, placed, most_ratio=1.05, least_gainful=12, most_overlap=0.05))


@query(f"WITH {sql.budget(DCG)}, o AS (SELECT query_id, policy, t, sum(effect) AS delta FROM bg GROUP BY ALL) SELECT 'delta_' || policy || '_t' || t AS metric, {r('avg(delta)', 'value')} FROM o GROUP BY policy, t")
def setting_outcomes(spark, d):
    return rounded(summaries.outcome_metrics(_budget(spark, d)).select("metric", "value"))


_HAT = "h0 AS (SELECT query_id, budget, -sum(effect) AS g_hat FROM x GROUP BY ALL), h1 AS (SELECT h0.*, abs(g_hat - g_q) AS error, label = 'gate_sensitive' AS so, g_hat > 0.05 AND g_hat > r_q AS said, round(g_hat, 9) + 0.0 AS a, round(g_q, 9) + 0.0 AS b FROM h0 JOIN dg USING (query_id))"


@query(
    f"""WITH {sql.stage(DCG)}, {sql.DIAGNOSIS}, {_probe_x(N.ALTERNATIVE, (5, 20))}, {_HAT}, h2 AS (SELECT *, {sql.average_rank('a', 'budget')} AS ar, {sql.average_rank('b', 'budget')} AS br FROM h1), h3 AS (SELECT *, {sql.weight(resample.poisson_steps())} AS w FROM h2, (SELECT unnest(range(0, 101)) AS draw)),
hd AS (SELECT budget, draw, sum(w) AS n, sum(w * error) AS error, coalesce(sum(w) FILTER (said AND so), 0) AS tp, coalesce(sum(w) FILTER (said AND NOT so), 0) AS fp, coalesce(sum(w) FILTER (so AND NOT said), 0) AS fn, sum(w * ar) AS x, sum(w * br) AS y, sum(w * ar * ar) AS xx, sum(w * br * br) AS yy, sum(w * ar * br) AS xy FROM h3 WHERE w > 0 GROUP BY ALL)
SELECT CAST(budget AS BIGINT) AS budget, statistic, {r('point', 'point')}, {r('lo', 'lo')}, {r('hi', 'hi')}, n_draws FROM ({sql.intervals('hd', 'budget', {'gq_mae': 'error / n', 'gq_spearman': sql.correlation('n', 'x', 'y', 'xx', 'yy', 'xy'), 'precision': 'tp / nullif(tp + fp, 0)', 'recall': 'tp / nullif(tp + fn, 0)', 'f1': 'coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)'})})"""
)
def probe_intervals(spark, d):
    own = _worlds(spark, d)
    return rounded(probes.query_intervals(probes.probe(own, [5, 20], N.ALTERNATIVE, DCG), summaries.diagnose(effects.stage_effects(own, DCG)), draws=100))


@query(
    f"""WITH {sql.stage(DCG)}, g AS (SELECT stratum, query_id, doc_id, effect, -CAST(rank_control AS DOUBLE) AS p FROM st WHERE effect_type = 'e_gate')
SELECT stratum, query_id, doc_id, {sql.average_rank('effect', 'stratum')} AS effect_rank, {sql.average_rank('p', 'stratum')} AS p_rank FROM g"""
)
def ranks_in_ranges(spark, d):
    """Average ranks within strata, most of whose effects are equal, without a task that holds a stratum."""
    rows = _stage(spark, d).where("effect_type = 'e_gate'").withColumn("p", -F.col("rank_control").cast("double"))
    return S.average_ranks(rows, {"effect_rank": "effect", "p_rank": "p"}, ["stratum"]).select("stratum", "query_id", "doc_id", "effect_rank", "p_rank")


# Effectiveness of a run


@query(
    f"""WITH {sql.runs(DEPTH)}, {sql.QRELS}, v AS (SELECT * FROM ru WHERE system = 'value'), g AS (SELECT qr.query_id, sum(CASE WHEN v.rank <= 10 THEN relevance / log2(CAST(v.rank AS DOUBLE) + 1) ELSE 0.0 END) AS dcg, count(*) FILTER (relevance >= 2) AS relevant, count(*) FILTER (relevance >= 2 AND v.rank <= {DEPTH}) AS found FROM qr LEFT JOIN v ON v.query_id = qr.query_id AND v.doc_id = qr.doc_id GROUP BY ALL),
i AS (SELECT query_id, sum(relevance / log2(CAST(n AS DOUBLE) + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS n FROM qr) WHERE n <= 10 GROUP BY ALL)
SELECT query_id, {r('CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0.0 END', 'ndcg')}, {r('CASE WHEN relevant > 0 THEN found / relevant END', 'recall')} FROM g JOIN i USING (query_id)"""
)
def effectiveness_by_query(spark, d):
    run = event_runs(spark, d, DEPTH).where("system = 'value'")
    qrels = event_qrels(spark, d)
    return rounded(ndcg(run, qrels, 10).select("query_id", "ndcg").join(recall(run, qrels, DEPTH).select("query_id", "recall"), "query_id"))


# Ingestion: text files and retrievers to a frozen universe. Its documents are events by their whole ids, since the
# chain refuses keys that repeat; what the SQL shows by seven digits is brought together at the end.


def _ingestion(spark, d, queries: DataFrame, settings: Settings) -> ingest.Ingestion:
    """Text files of ``queries(query_id, text)`` and the events' judgments, taken in."""
    asked, judged = scratch(spark, "queries-text"), scratch(spark, "qrels-text")
    queries.select(F.concat_ws("\t", "query_id", F.translate("text", "\n\t", "  ")).alias("value")).write.text(asked)
    event_qrels(spark, d, whole=True).select(F.concat_ws(" ", "query_id", F.lit("0"), "doc_id", F.col("relevance").cast("string")).alias("value")).write.text(judged)
    chain = ingest.Ingestion(spark, scratch(spark, "ingestion"), settings)
    chain.prepare(asked, judged)
    return chain


def _items(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("query_id"), "text")


_BM25 = Settings(sources=("bm25",), stage1_systems=("bm25",), policies=("boundary",), depth_m=50, candidate_depths=(K_C,), k=K, other_cutoffs=(5,))


@query("WITH h AS (SELECT query_id, row_number() OVER (ORDER BY sha256('42/' || query_id), query_id) AS n, count(*) OVER () AS total FROM (SELECT 'b' || CAST(item_id AS VARCHAR) AS query_id FROM benchmark)) SELECT query_id, CASE WHEN n <= floor(0.5 * total + 0.5) THEN 'train' WHEN n <= floor(0.7 * total + 0.5) THEN 'val' ELSE 'test' END AS split FROM h")
def ingest_split(spark, d):
    return _ingestion(spark, d, _items(spark, d), _BM25).split()


@query(f"SELECT query_id, count(doc_id) AS n_docs, count(doc_id) < 50 AS shallow FROM (SELECT 'b' || CAST(item_id AS VARCHAR) AS query_id FROM benchmark) LEFT JOIN ({ORACLES['bm25_topk']}) USING (query_id) GROUP BY ALL")
def ingest_depths(spark, d):
    """How deep a run of the benchmark's items over all documents is."""
    chain = _ingestion(spark, d, _items(spark, d), _BM25)
    chain.retrieve("bm25", corpus=table(spark, d, "documents").select("doc_id", "text"))
    return ingest.depths(chain.queries(), chain.run("bm25"), 50)


_STORED = Settings(sources=("value", "mix"), optional_sources=(), stage1_systems=("value", "mix"), alternative_source="mix", depth_m=DEPTH, candidate_depths=(K_C, 30), k=K, other_cutoffs=(5,))


def _taken_over(spark, d) -> ingest.Ingestion:
    queries = event_cascade(spark, d).select("query_id").distinct().withColumn("text", F.col("query_id"))
    chain = _ingestion(spark, d, queries, _STORED)
    stored = scratch(spark, "stored-runs")  # ranked once, not for each check
    event_runs(spark, d, DEPTH, whole=True).write.parquet(stored)
    for system in _STORED.sources:
        chain.retrieve(system, stored=spark.read.parquet(stored).where(F.col("system") == system))
    chain.freeze()
    return chain


@query(f"WITH {sql.universe(DEPTH)} SELECT query_id, doc_id, sources FROM un")
def ingest_universe(spark, d):
    rows = short(_taken_over(spark, d).universe()).groupBy("query_id", "doc_id")
    every = F.flatten(F.collect_list(F.split("sources", ",")))
    return rows.agg(F.array_join(F.array_sort(F.array_distinct(every)), ",").alias("sources"))


@query(
    f"""WITH {sql.universe(DEPTH)}, us AS (SELECT query_id, doc_id, system FROM un, (SELECT unnest(['value', 'mix']) AS system)), ff AS (SELECT us.query_id, us.doc_id, us.system, ru.score IS NOT NULL AS retrieved, coalesce(ru.score, min(ru.score) OVER (PARTITION BY us.query_id, us.system) - 1, 0.0) AS score
FROM us LEFT JOIN ru ON ru.query_id = us.query_id AND ru.doc_id = us.doc_id AND ru.system = us.system) SELECT query_id, doc_id, system, row_number() OVER (PARTITION BY query_id, system ORDER BY score DESC, doc_id) AS rank, {r('score', 'score')} FROM ff"""
)
def ingest_stage1(spark, d):
    """Both first stages' tables at the end of the chain. Of events with the same seven digits all that were
    retrieved are listed, or one at the floor."""
    chain = _taken_over(spark, d)
    chain.first_stages()
    key = ["query_id", "doc_id", "system"]
    got = chain.run(*_STORED.stage1_systems).select(*key, F.lit(True).alias("got"))
    rows = short(chain.stage1("value").unionByName(chain.stage1("mix")).join(got, key, "left"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("rank"))).where("got or n = 1")
    order = Window.partitionBy("query_id", "system").orderBy(F.desc("score"), "doc_id")
    return rounded(rows.select(*key, F.row_number().over(order).alias("rank"), "score"))


# Shards of a universe: customers are queries and their orders documents. SQL deals them out one after the other.

_DEALT = """pu AS (SELECT 'c' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS query_id, count(*) AS pairs FROM orders GROUP BY ALL), po AS (SELECT *, row_number() OVER (ORDER BY pairs DESC, query_id) AS n FROM pu),
ps AS (SELECT CAST(0 AS BIGINT) AS n, CAST([0, 0, 0] AS BIGINT[]) AS held, CAST(NULL AS BIGINT) AS shard UNION ALL
 SELECT po.n, [held[1] + CASE WHEN list_position(held, list_min(held)) = 1 THEN pairs ELSE 0 END, held[2] + CASE WHEN list_position(held, list_min(held)) = 2 THEN pairs ELSE 0 END, held[3] + CASE WHEN list_position(held, list_min(held)) = 3 THEN pairs ELSE 0 END], CAST(list_position(held, list_min(held)) AS BIGINT) - 1 FROM ps JOIN po ON po.n = ps.n + 1)"""


def _dealt(spark, d) -> DataFrame:
    return plan_shards(table(spark, d, "orders").select(F.concat(F.lit("c"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("query_id"), F.col("o_orderkey").cast("string").alias("doc_id")), 3)


@query(f"WITH RECURSIVE {_DEALT} SELECT query_id, pairs, shard FROM ps JOIN po USING (n)")
def shard_dealing(spark, d):
    return rounded(_dealt(spark, d))


@query(f"WITH RECURSIVE {_DEALT} SELECT shard, count(*) AS n_queries, CAST(sum(pairs) AS BIGINT) AS n_pairs FROM ps JOIN po USING (n) GROUP BY ALL")
def shard_sizes(spark, d):
    return rounded(shard_loads(_dealt(spark, d)))
