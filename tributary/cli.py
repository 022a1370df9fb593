"""Command lines: ``python -m tributary.cli prepare|retrieve|freeze|shards|grid|cells|analyse|study|compare|outsiders|feasibility|merge --help``.

Studies are recomputed only where their inputs, settings or steps changed.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config, contracts
from .functions.utility import Utility
from .operators import judgments, summaries, universe
from .plans import assembly, feasibility, grid, reports, runner
from .plans.ingest import Ingestion
from .sources import score_store, shard_merge
from .sources.score_store import ScoreStore


def assemble(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The cascade of one first stage from a universe, runs, judgments and scores on disk."""
    uni = contracts.load(spark, a.universe, "universe")
    runs = contracts.load(spark, a.runs, "run")
    scores = contracts.load(spark, a.scores, "stage2_cache")
    assembly.require_fit(uni, {"scores": scores}, ["scores"])
    s1 = universe.floored(runs, a.system, uni).select("query_id", "doc_id", F.col("score").alias("s1"))
    alt = runs.where(F.col("system") == a.other).select("query_id", "doc_id", F.col("rank").cast("int").alias("alt_rank"))
    s2 = scores.select("query_id", "doc_id", F.col("score").alias("s2"))
    key = ["query_id", "doc_id"]
    rows = judgments.attach(uni.select(*key), contracts.load(spark, a.qrels, "qrels"))
    return rows.join(s1, key).join(s2, key, "left").join(alt, key, "left")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tributary")
    parser.add_argument("--settings", help="YAML file of settings")
    sub = parser.add_subparsers(dest="command", required=True)
    pr = sub.add_parser("prepare", help="queries, judgments and split from text files")
    for name in ("queries", "qrels", "out"):
        pr.add_argument(f"--{name}", required=True)
    re = sub.add_parser("retrieve", help="one system's run to the universe's depth: BM25, inner product, or a stored run")
    for name in ("system", "out"):
        re.add_argument(f"--{name}", required=True)
    for name in ("corpus", "vectors", "from-run"):
        re.add_argument(f"--{name}")
    re.add_argument("--depth", type=int)
    fr = sub.add_parser("freeze", help="the universe of all runs, and each first stage's table over it")
    fr.add_argument("--out", required=True)
    sh = sub.add_parser("shards", help="deal the universe's queries to owners, even by pairs")
    for name in ("universe", "out"):
        sh.add_argument(f"--{name}", required=True)
    sh.add_argument("--shards", type=int, default=3)
    g = sub.add_parser("grid", help="effect tables of one first stage over the whole grid")
    for name in ("universe", "runs", "qrels", "scores", "system", "other", "out"):
        g.add_argument(f"--{name}", required=True)
    n = sub.add_parser("analyse", help="diagnosis, distributions and outcomes of written effect tables")
    n.add_argument("--effects", required=True)
    n.add_argument("--k-c", type=int, required=True)
    n.add_argument("--out", required=True)
    c = sub.add_parser("cells", help="the grid of one first stage, cell by cell; goes on where it was stopped")
    for name in ("universe", "runs", "qrels", "scores", "system", "other", "out"):
        c.add_argument(f"--{name}", required=True)
    st = sub.add_parser("study", help="diagnosis, outcomes, tests and intervals of written effect tables")
    st.add_argument("--effects", required=True)
    st.add_argument("--out", required=True)
    st.add_argument("--draws", type=int, default=1000)
    st.add_argument("--permutations", type=int, default=10_000)
    co = sub.add_parser("compare", help="two systems' effect tables side by side, one axis at a time")
    for name in ("effects", "first", "second", "out"):
        co.add_argument(f"--{name}", required=True)
    ou = sub.add_parser("outsiders", help="which outsiders were promoted, and which failures a policy left out")
    for name in ("effects", "qrels", "out"):
        ou.add_argument(f"--{name}", required=True)
    me = sub.add_parser("merge", help="merge score stores of several owners and commit a manifest")
    me.add_argument("--shard", action="append", required=True, metavar="OWNER=PATH")
    for name in ("universe", "model", "out"):
        me.add_argument(f"--{name}", required=True)
    me.add_argument("--on-conflict", choices=shard_merge.RULES)
    me.add_argument("--allow-gaps", action="store_true")
    f = sub.add_parser("feasibility", help="can the runs and judgments answer the questions?")
    for name in ("runs", "qrels", "out"):
        f.add_argument(f"--{name}", required=True)
    a = parser.parse_args(argv)
    settings = config.load(a.settings) if a.settings else config.Settings()
    spark = SparkSession.builder.appName("tributary").getOrCreate()
    if a.command == "prepare":
        print(json.dumps(Ingestion(spark, a.out, settings).prepare(a.queries, a.qrels)))
    elif a.command == "retrieve":
        given = {n: spark.read.parquet(p) for n, p in (("corpus", a.corpus), ("vectors", a.vectors)) if p}
        if a.from_run:
            given["stored"] = contracts.load(spark, a.from_run, "run")
        print(json.dumps(Ingestion(spark, a.out, settings).retrieve(a.system, depth=a.depth, **given)))
    elif a.command == "freeze":
        chain = Ingestion(spark, a.out, settings)
        print(json.dumps({"universe": chain.freeze(), "stage1": chain.first_stages()}))
    elif a.command == "shards":
        score_store.plan_shards(contracts.load(spark, a.universe, "universe"), a.shards).write.mode("overwrite").parquet(a.out)
        print(json.dumps({r.shard: {"queries": r.n_queries, "pairs": r.n_pairs} for r in score_store.shard_loads(spark.read.parquet(a.out)).collect()}))
    elif a.command == "grid":
        grid.write_grid(grid.effect_grid(assemble(spark, a), settings, a.system), a.out)
    elif a.command == "analyse":
        stage = grid.read_grid(spark, a.effects, k_c=a.k_c, kind="stage").where((F.col("utility") == settings.utility) & (F.col("k") == settings.k))
        budget = grid.read_grid(spark, a.effects, k_c=a.k_c, kind="budget").where((F.col("utility") == settings.utility) & (F.col("k") == settings.k))
        for name, table in {"diagnosis": summaries.diagnose(stage, settings.tau_query), "distributions": summaries.distributions(stage), "outcomes": summaries.budget_outcomes(budget), "unjudged": summaries.unjudged_at_k(stage)}.items():
            reports.save_table(table, f"{a.out}/{name}")
    elif a.command == "cells":
        print(json.dumps(grid.write_cells(assemble(spark, a), settings, a.system, a.out)))
    elif a.command == "study":
        _study(spark, a.out, settings, runner.analysis(settings, a.draws, a.permutations), effects=spark.read.parquet(a.effects))
    elif a.command == "compare":
        _study(spark, a.out, settings, runner.comparison(settings, a.first, a.second), effects=spark.read.parquet(a.effects))
    elif a.command == "outsiders":
        rows = spark.read.parquet(a.effects)
        n = rows.select("query_id").distinct().count()
        _study(spark, a.out, settings, runner.outsiders(settings, n), effects=rows, qrels=contracts.load(spark, a.qrels, "qrels"))
    elif a.command == "merge":
        stores = {owner: ScoreStore(spark, path) for owner, _, path in (s.partition("=") for s in a.shard)}
        universe = contracts.load(spark, a.universe, "universe")
        print(json.dumps(shard_merge.merge(spark, a.out, stores, a.model, universe, on_conflict=a.on_conflict, allow_gaps=a.allow_gaps, fingerprint=settings.fingerprint)))
    else:
        runs, qrels = contracts.load(spark, a.runs, "run"), contracts.load(spark, a.qrels, "qrels")
        u = Utility(settings.utility, settings.k, settings.persistence, settings.gains)
        systems, depths = list(settings.stage1_systems), list(settings.candidate_depths)
        outs, lever = feasibility.outside(runs, qrels, u.gain, systems, depths), feasibility.leverage(runs, systems, depths)
        reports.save_table(feasibility.verdict(lever, outs), f"{a.out}/verdict")
        placed = feasibility.placement(runs, universe.build(runs, settings.depth_m), qrels, systems, depths)
        reports.save_table(feasibility.findings(lever, outs, placed), f"{a.out}/findings")
    return 0


def _study(spark: SparkSession, path: str, settings: config.Settings, steps: list[runner.Step], **inputs: DataFrame) -> None:
    print(json.dumps(runner.Study(spark, path, settings, steps).run(**inputs)))


if __name__ == "__main__":
    raise SystemExit(main())
