import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests import toy
from tributary import cli, contracts
from tributary.config import Settings, split_queries
from tributary.errors import InputError, ListwiseScorerError, PassageError, UniverseError
from tributary.functions.utility import Utility
from tributary.operators import effects, features, resample, summaries, synthetic, worlds
from tributary.plans import feasibility, grid, reports, study
from tributary.sources import embeddings, files

SMALL = Settings(candidate_depths=(8, 12), depth_m=30, k=5, other_cutoffs=(3,), other_utilities=("topk",), budget_seeds=(42,), sources=("bm25", "dpr"))


@pytest.fixture(scope="module")
def cascade(spark):
    return synthetic.generate(spark, synthetic.Regime(0.7, 0.9, 0.3, 0.2), 6, 40).cache()


def test_grid_is_written_and_pruned(spark, cascade, tmp_path):
    rows = grid.effect_grid(cascade, SMALL, "bm25")
    for r in effects.violations(rows).collect():
        assert sum(r[c] for c in r.asDict() if c not in ("effect_type", "n")) == 0
    grid.write_grid(rows, str(tmp_path / "g"))
    part = grid.read_grid(spark, str(tmp_path / "g"), system="bm25", k_c=8, kind="stage", condensed=False)
    assert "PartitionFilters: [isnotnull" in part._jdf.queryExecution().toString()
    assert part.count() == 6 * 40 * 2 * 3
    assert 0 == cli.main(["analyse", "--effects", str(tmp_path / "g"), "--k-c", "8", "--out", str(tmp_path / "r")])


def test_grid_command(spark, tmp_path):
    c = toy.cascade(spark)
    runs = c.select("query_id", "doc_id", F.lit("bm25").alias("system"), F.expr("row_number() over (order by s1 desc)").cast("long").alias("rank"), F.col("s1").alias("score"), F.lit("v").alias("checkpoint"))
    runs = runs.unionByName(c.select("query_id", "doc_id", F.lit("dpr").alias("system"), F.col("alt_rank").cast("long").alias("rank"), (-F.col("alt_rank")).cast("double").alias("score"), F.lit("v").alias("checkpoint")))
    contracts.save(runs, str(tmp_path / "runs"), "run")
    contracts.save(c.select("query_id", "doc_id", F.lit("bm25,dpr").alias("sources")), str(tmp_path / "u"), "universe")
    contracts.save(c.select("query_id", "doc_id", "relevance", "judged"), str(tmp_path / "q"), "qrels")
    contracts.save(c.select("query_id", "doc_id", F.lit("m").alias("model"), F.col("s2").alias("score")), str(tmp_path / "s"), "stage2_cache")
    (tmp_path / "y").write_text("candidate_depths: [4]\ndepth_m: 10\nk: 2\nother_cutoffs: []\nother_utilities: []\nbudget_seeds: [42]\n")
    args = [x for n, p in (("universe", "u"), ("runs", "runs"), ("qrels", "q"), ("scores", "s"), ("out", "g")) for x in (f"--{n}", str(tmp_path / p))]
    assert cli.main(["--settings", str(tmp_path / "y"), "grid", *args, "--system", "bm25", "--other", "dpr"]) == 0
    got = spark.read.parquet(str(tmp_path / "g")).where("effect_type = 'e_gate' and doc_id = 'e' and not condensed").first()
    assert got.effect == -7


def test_allocation_tables_agree(spark, cascade):
    from tributary.operators import allocation

    spent = allocation.allocate(worlds.build_worlds(cascade, [8]), allocation.parameters(spark, [8], [1.0, 0.5], ["boundary", "random"], [42]))
    a = grid.promoted(spent)
    assert grid.allocation_mismatches(a, a).count() == 0
    assert grid.allocation_mismatches(a, a.where("policy <> 'boundary'")).count() == 6 * 4


def test_feasibility(spark):
    rows = [(f"q{q}", f"d{(q + r * m) % 40}", s, r, float(-r), "v") for q in range(4) for s, m in (("a", 1), ("b", 3)) for r in range(1, 21)]
    runs = spark.createDataFrame(rows, contracts.SCHEMAS["run"])
    qrels = spark.createDataFrame([(f"q{q}", f"d{i}", 3, True) for q in range(4) for i in range(40)], contracts.SCHEMAS["qrels"])
    outs = feasibility.outside(runs, qrels, Utility().gain, ["a", "b"], [5, 10])
    v = feasibility.verdict(feasibility.leverage(runs, ["a", "b"], [5, 10]), outs)
    assert v.count() == 4 and feasibility.headline_depth(v) == 5
    assert feasibility.effectiveness(runs.where("system = 'a'"), qrels, {"ndcg": 1.0, "recall": 0.5}).where("not agrees").count() == 0


def test_files(spark, tmp_path):
    split = split_queries([f"q{i}" for i in range(10)], {"train": 0.5, "val": 0.2, "test": 0.3}, 42)
    files.write_split(str(tmp_path / "s"), split, 42)
    assert files.read_split(str(tmp_path / "s")) == split
    files.check_split(split, [f"q{i}" for i in range(10)])
    with pytest.raises(InputError):
        files.check_split(split, ["q1"])
    assert files.split_table(spark, split).count() == 10
    files.write_ids(str(tmp_path / "i"), ["b", "a"])
    assert files.read_ids(str(tmp_path / "i")) == ["b", "a"]
    u = spark.createDataFrame([("q", "d", "a")], contracts.SCHEMAS["universe"])
    files.freeze(u, str(tmp_path / "u"), "abc")
    assert files.load_frozen(spark, str(tmp_path / "u"), "abc").columns == u.columns
    with pytest.raises(UniverseError):
        files.load_frozen(spark, str(tmp_path / "u"), "other")
    with pytest.raises(Exception, match="already exists"):
        files.freeze(u, str(tmp_path / "u"), "abc")


def test_embeddings_fill_what_is_missing(spark, tmp_path):
    def encoder(texts):
        return np.array([[len(t), 1.0] for t in texts])

    texts = spark.createDataFrame([(f"d{i}", "x" * i) for i in range(6)], "doc_id string, text string")
    for part in (texts.where("doc_id < 'd3'"), texts, texts):
        embeddings.fill(spark, str(tmp_path / "e"), part, encoder)
    got = embeddings.check(spark.read.schema(embeddings.SCHEMA).parquet(str(tmp_path / "e")))
    assert got.count() == 6 and got.where("abs(vector[0] * vector[0] + vector[1] * vector[1] - 1) > 1e-6").count() == 0
    with pytest.raises(InputError):
        embeddings.check(got.union(got))


def test_scorers(spark):
    def scorer(q, t):
        return t.str.len() + q.str.len()

    pairs = spark.createDataFrame([("q", "abc"), ("qq", "a")], "query string, text string")
    assert sorted(r.score for r in reports.scored(pairs, scorer, 1).collect()) == [3, 4]
    scorer.listwise = True
    with pytest.raises(ListwiseScorerError):
        reports.scored(pairs, scorer)
    assert reports.canary_digest(scorer) == reports.canary_digest(scorer)
    assert reports.canaries_agree([1.0, 2.0], [1.00001, 2.0]) and not reports.canaries_agree([1.0, 2.0], [2.0, 1.0])
    s = spark.createDataFrame([("q", "a", "m", 0.5), ("q", "b", "m", 0.25)], contracts.SCHEMAS["stage2_cache"])
    assert reports.score_digest(s) == reports.score_digest(s.orderBy(F.desc("doc_id")).repartition(3)) != reports.score_digest(s.limit(1))


def test_reports(spark, cascade, tmp_path):
    stage = effects.stage_effects(worlds.build_worlds(cascade, [8]), Utility("dcg", 5))
    ids = stage.select("query_id").distinct().withColumn("text", F.col("query_id"))
    texts = stage.select("doc_id").distinct().withColumn("text", F.repeat(F.lit("long text "), 60))
    got = reports.gating_examples(stage, ids, texts, 3)
    assert got.where("length(passage) > 230").count() == 0
    assert reports.markdown(got).count("\n") == got.count() + 1
    with pytest.raises(PassageError):
        reports.gating_examples(stage, ids, texts.limit(0), 3)
    reports.save_table(summaries.strata_sizes(stage), str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), header=True).count() == 4
    reports.write_manifest(str(tmp_path / "m"), {"a": 1})
    assert reports.read_manifest(str(tmp_path / "m")) == {"a": 1}
    row = reports.off_diagonal(effects.additivity(stage)).first()
    assert row.max_residual < 1e-9


def test_mechanisms_show(spark):
    assert study.directional_checks(spark).holds.all()


def test_power_grows_with_the_effect(spark):
    rng = np.random.default_rng(0)
    rows = pd.DataFrame({"query_id": [f"q{i}" for i in range(40)], "label": ["gate_sensitive", "rerank_sensitive"] * 20, "delta_dcg": rng.normal(size=40) + np.tile([3.0, 0.0], 20)})
    got = resample.power(spark.createDataFrame(rows), [4, 20], simulations=30, permutations=100)
    assert study.smallest_sufficient(got) == 20
    pool = study.simulate_pool(spark, synthetic.Regime(0.7, 0.9, 0.3, 0.2), 6, 60, 10, 0.5, "alternative", Utility("dcg", 5), planted=3)
    assert pool.count() == 6


def test_models_by_stratum(spark, cascade):
    own = worlds.build_worlds(cascade, [8])
    stage = effects.stage_effects(own, Utility("dcg", 5)).where("effect_type = 'e_gate'").withColumn("k_c", F.col("k_c").cast("int"))
    frame = features.attach(stage, features.wide(own, 5, 30))
    got = study.fit_by_stratum(frame, {"survivor": features.SURVIVOR}, "query_id < 'sq0003'")
    assert got.count() == 3 * 40 and got.where("stratum = 'non_survivor' and prediction <> 0").count() == 0
    a = summaries.diagnose(effects.stage_effects(own, Utility("dcg", 5)))
    assert study.contrast(a, a)["only_a"] == 0
