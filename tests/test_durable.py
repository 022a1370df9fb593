"""Merges, commits and runs that are stopped: refusals, and equality of resumed and whole runs."""

import json
import pathlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary import cli, config, contracts
from tributary.config import Settings
from tributary.errors import ConflictError, ContractError, InputError, ListwiseScorerError, MissingScoreError
from tributary.functions import statistics as S
from tributary.functions.utility import Utility
from tributary.operators import effects, features, resample, rescoring, worlds
from tributary.plans import assembly, catalog, grid, ingest, runner
from tributary.plans.cascades import event_cascade, event_qrels
from tributary.sources import embeddings, shard_merge, vector_format
from tributary.sources.commits import CommitLog, content
from tributary.sources.score_store import ScoreStore

from .test_queries import normal

PAIRS = "query_id string, doc_id string"
SCORES = f"{PAIRS}, model string, score double"


def stores(spark, path, **rows):
    out = {}
    for owner, scores in rows.items():
        out[owner] = ScoreStore(spark, str(path / owner))
        out[owner].put(spark.createDataFrame([("q", d, "m", s) for d, s in scores.items()], SCORES), version=len(out))
    return out


def test_merge_refuses_what_nobody_settled(spark, tmp_path):
    universe = spark.createDataFrame([("q", d) for d in "abcd"], PAIRS)
    shards = stores(spark, tmp_path, one={"a": 1.0, "b": 2.0}, two={"b": 2.5, "c": 3.0, "x": 9.0})
    path = str(tmp_path / "merged")
    with pytest.raises(ConflictError, match="1 pairs"):
        shard_merge.merge(spark, path, shards, "m", universe, allow_gaps=True)
    with pytest.raises(MissingScoreError, match="1 pairs"):
        shard_merge.merge(spark, path, shards, "m", universe, on_conflict="first")
    with pytest.raises(InputError, match="no merge"):
        shard_merge.merged_scores(spark, path, "m")
    first = shard_merge.merge(spark, path, shards, "m", universe, on_conflict="first", allow_gaps=True)
    assert (first["asked"], first["merged"], first["missing"], first["conflicts"], first["strays"], first["complete"]) == (4, 3, 1, 1, 1, False)
    assert {r.doc_id: r.score for r in shard_merge.merged_scores(spark, path, "m").collect()} == {"a": 1, "b": 2, "c": 3}
    latest = shard_merge.merge(spark, path, shards, "m", universe, on_conflict="latest", allow_gaps=True)
    assert latest["mark"] != first["mark"] and {r.doc_id: r.score for r in shard_merge.merged_scores(spark, path, "m").collect()}["b"] == 2.5
    near = shard_merge.reconcile(shard_merge.labelled(shards, "m"), universe, tolerance=0.5)
    assert {r.doc_id: r.status for r in near.collect()} == {"a": "single", "b": "repeated", "c": "single", "d": "gap", "x": "stray"}


def test_merging_twice_writes_nothing(spark, tmp_path):
    one, two = stores(spark, tmp_path, one={"a": 1.0}, two={"b": 2.0}).values()
    for _ in range(2):
        one.merge_from(two, "m")
    assert spark.read.parquet(one.path).count() == 2


def test_commit_log(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.done() == {}
    log.begin(a=1, b=[1, 2])
    log.begin(a=1, b=(1, 2))
    with pytest.raises(InputError, match="begun with"):
        log.begin(a=2, b=[1, 2])
    log.commit({"x": {"n": 1}, "y": {"n": 2}})
    log.commit({"x": {"n": 3}})
    assert log.done() == {"x": {"n": 3}, "y": {"n": 2}}


def test_content_ignores_order_and_counts_repeats(spark):
    a = spark.range(50).select("id", F.lit("x").alias("t"))
    digest = content(a, "id", "t").first()
    assert content(a.orderBy(F.desc("id")).repartition(3), "id", "t").first() == digest
    assert content(a.union(a.limit(1)), "id", "t").first() != digest and content(a.limit(0), "id", "t").first().rows == 0


def test_vector_shards(spark, tmp_path):
    path = str(tmp_path / "v")
    vector_format.register(spark)
    rows = spark.createDataFrame([(f"d{i}", [float(i), 0.5], i % 3) for i in range(20)], vector_format.SCHEMA)
    rows.repartitionByRange(2, "shard").sortWithinPartitions("shard", "doc_id").write.format(vector_format.FORMAT).mode("append").save(path)
    back = spark.read.format(vector_format.FORMAT).load(path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect())) and back.rdd.getNumPartitions() == 3
    assert json.loads((tmp_path / "v" / "meta.json").read_text()) == {"dim": 2, "dtype": "float16"}
    assert np.load(tmp_path / "v" / "emb_00001.npy").dtype == np.float16
    with pytest.raises(Exception, match="lengths"):
        spark.createDataFrame([("e", [1.0], 3)], vector_format.SCHEMA).write.format(vector_format.FORMAT).mode("append").save(path)
    assert len(list((tmp_path / "v").glob("*.tmp"))) == 0 and vector_format.shard_numbers(path) == [0, 1, 2]
    (tmp_path / "v" / "emb_00001.npy").unlink()
    with pytest.raises(Exception, match="missing"):
        spark.read.format(vector_format.FORMAT).load(path).count()


def test_a_stopped_encoding_goes_on(spark, tmp_path):
    texts = spark.createDataFrame([(f"d{i}", "x" * i) for i in range(40)], "doc_id string, text string")

    def encoder(ts):
        return np.eye(4)[[len(t) % 4 for t in ts]]

    def failing(ts):
        if any(len(t) == 39 for t in ts):
            raise RuntimeError("stopped")
        return encoder(ts)

    whole, part = str(tmp_path / "whole"), str(tmp_path / "part")
    report = embeddings.encode_shards(spark, whole, texts, encoder, "toy", shard_rows=8, wave=1)
    assert report["encoded"] == list(range(len(report["encoded"]))) and not report["held"]
    with pytest.raises(Exception, match="stopped"):
        embeddings.encode_shards(spark, part, texts, failing, "toy", shard_rows=8, wave=1)
    again = embeddings.encode_shards(spark, part, texts, encoder, "toy", shard_rows=8, wave=1)
    assert sorted(again["encoded"] + again["held"]) == report["encoded"] and again["encoded"]
    assert embeddings.encode_shards(spark, part, texts, encoder, "toy", shard_rows=8, wave=1)["encoded"] == []
    read = [sorted(map(tuple, spark.read.format(vector_format.FORMAT).load(p).collect())) for p in (whole, part)]
    assert read[0] == read[1] and len(read[0]) == 40
    for other, name, size in ((texts, "other", 8), (texts.limit(39), "toy", 8), (texts, "toy", 4)):
        with pytest.raises(InputError, match="begun with"):
            embeddings.encode_shards(spark, part, other, encoder, name, shard_rows=size)
    with pytest.raises(InputError, match="repeats"):
        embeddings.encode_shards(spark, str(tmp_path / "twice"), texts.union(texts.limit(1)), encoder, "toy")


def test_batches_are_packed_by_length():
    got = list(embeddings.packed([100, 40, 30, 10, 1, 0], 100))
    assert got == [(0, 1), (1, 3), (3, 6)] and list(embeddings.packed([], 10)) == []


def test_a_stopped_grid_goes_on(spark, tmp_path):
    c = event_cascade(spark, "/root/testdata/sf0.001")
    s = Settings(candidate_depths=(10,), depth_m=60, k=5, other_cutoffs=(), other_utilities=(), policies=("boundary",))
    path, calls = str(tmp_path / "g"), []

    def stop(name):
        calls.append(name)
        if len(calls) == 2:
            raise InterruptedError

    with pytest.raises(InterruptedError):
        grid.write_cells(c, s, "value", path, before_commit=stop)
    assert [r.cell for r in grid.cell_records(spark, path).collect()] == ["value-k10-stage"]
    assert grid.write_cells(c, s, "value", path) == {"written": ["value-k10-boundary"], "held": ["value-k10-stage"]}
    assert grid.write_cells(c, s, "value", path)["written"] == []
    whole = grid.effect_grid(c, s, "value")
    assert grid.read_cells(spark, path).exceptAll(whole).count() == 0 and grid.read_cells(spark, path).count() == whole.count()
    with pytest.raises(InputError, match="begun with"):
        grid.write_cells(c, s, "value", path, modes=[False])
    with pytest.raises(ContractError, match="no cell"):
        grid.read_cells(spark, path, k_c=99)


def test_baselines_that_are_none(spark):
    rows = [("q", "a", 2, False, "boundary", None, 2, 1.0, True, True, 1, 1), ("q", "b", 2, False, "boundary", None, 2, 1.0, True, True, 2, 2), ("q", "c", 2, False, "boundary", None, 2, 1.0, False, False, None, None)]
    schema = "query_id string, doc_id string, k_c int, condensed boolean, policy string, seed int, budget int, t double, in_cq boolean, submitted boolean, rank_t int, rank_a int"
    good = spark.createDataFrame(rows, schema)
    assert worlds.baseline_agreement(good).first().agrees
    swapped = good.withColumn("rank_t", 3 - F.col("rank_t"))
    moved = good.withColumn("submitted", F.col("doc_id") != "a")
    poor = good.withColumn("budget", F.lit(1))
    assert worlds.baseline_agreement(swapped).first().wrong_ranks == 2
    assert worlds.baseline_agreement(moved).first().wrong_members == 2 and not worlds.baseline_agreement(moved).first().agrees
    assert worlds.baseline_agreement(poor).first().unspent == -1


def test_poisson_weights(spark):
    steps = resample.poisson_steps()
    assert steps == sorted(steps) and abs(steps[0] / 2**32 - 0.36788) < 1e-5
    t = spark.range(2000).select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("query_id"))
    w = t.select(resample.weight(1, F.lit(3), F.col("query_id")).alias("w"), resample.weight(1, F.lit(0), F.col("query_id")).alias("same")).toPandas()
    assert abs(w["w"].mean() - 1) < 0.08 and abs(w["w"].var() - 1) < 0.15 and (w["same"] == 1).all()


def test_replicates_cover_a_mean(spark):
    rng = np.random.default_rng(3)
    rows = [("g", f"q{i}", float(x), 1.0) for i, x in enumerate(rng.normal(2, 1, 400))]
    t = spark.createDataFrame(rows, "g string, query_id string, x double, n double")
    got = resample.replicate_intervals(t, ["g"], {"mean": resample.weighted_mean("x", "n")}, ["x", "n"], draws=300).first()
    x = np.array([r[2] for r in rows])
    assert got.point == pytest.approx(x.mean()) and got.n_draws == 300
    assert got.hi - got.lo == pytest.approx(2 * 1.96 * x.std() / 20, rel=0.2) and got.lo < got.point < got.hi


def test_permutations_find_a_difference(spark):
    rows = [(f"q{i}", "gate_sensitive" if i < 12 else "rerank_sensitive", float(i < 12) * 5 + i % 3, "a", 0.5) for i in range(30)]
    t = spark.createDataFrame(rows, "query_id string, label string, delta_dcg double, policy string, t double")
    d = t.select("query_id", "label", F.col("delta_dcg").alias("g_q"))
    got = resample.h7_permutations(d, t.select("query_id", "delta_dcg", "policy", "t"), permutations=199).first()
    assert got.p_value == 1 / 200 and got.rho == pytest.approx(1) and got.n_gate_sensitive == 12
    alike = resample.h7_permutations(d, t.select("query_id", (F.substring("query_id", 2, 3).cast("int") % 2).cast("double").alias("delta_dcg"), "policy", "t"), permutations=199).first()
    assert alike.p_value > 0.05
    few = resample.h7_permutations(d.withColumn("label", F.when(F.col("query_id") == "q1", "gate_sensitive").otherwise("rerank_sensitive")), t.select("query_id", "delta_dcg", "policy", "t"), permutations=19).first()
    assert few.p_value is None and few.difference is None


def test_ridge_of_groups_is_the_closed_form(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 2))
    rows = [("g" if i % 2 else "h", float(a), float(b), 7.0, float(2 * a - b + rng.normal())) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame([*rows, ("few", 1.0, 2.0, 7.0, 3.0), ("g", None, 1.0, 7.0, 1.0)], "g string, a double, b double, c double, effect double")
    models = {r.g: r for r in features.solve(features.gram(df, ["g"], ["a", "b", "c"]), ["g"], ["a", "b", "c"]).collect()}
    for g in "gh":
        own = np.array([r[1:] for r in rows if r[0] == g])
        z = (own[:, :2] - own[:, :2].mean(0)) / own[:, :2].std(0)
        w = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (own[:, 3] - own[:, 3].mean())) / own[:, :2].std(0)
        assert models[g].weights == pytest.approx([*w, 0.0]) and models[g].intercept == pytest.approx(own[:, 3].mean() - own[:, :2].mean(0) @ w)
    assert models["few"].weights == [0, 0, 0] and models["few"].intercept == 3
    got = features.predict(df, spark.createDataFrame(list(models.values())), ["g"], ["a", "b", "c"])
    assert got.where("a is null").first().prediction is None and got.where("prediction is null").count() == 1


def test_assembly_names_its_reasons(spark):
    def t(*pairs):
        return spark.createDataFrame(list(pairs), PAIRS)

    universe, runs, scores = t(("q", "a"), ("q", "b"), ("q", "b")), t(("q", "a"), ("q", "z")), t(("q", "a"), ("q", "a"), (None, "c"))
    got = {tuple(r) for r in assembly.reasons(universe, {"runs": runs, "scores": scores}, ["scores"]).collect()}
    assert got == {("q", "b", "universe", "doubled"), ("q", "z", "runs", "unasked"), ("q", "a", "scores", "doubled"), ("q", "b", "scores", "lost"), (None, "c", "scores", "no_key")}
    with pytest.raises(InputError, match="1 pairs lost in scores"):
        assembly.require_fit(universe, {"runs": runs, "scores": scores}, ["scores"])
    assembly.require_fit(t(("q", "a")), {"runs": t(("q", "a"))}, ["runs"])


def test_scorers_that_look_around(spark):
    pairs = spark.createDataFrame([(i, "q", "x" * (i % 17)) for i in range(100)], "id long, query string, text string")

    def honest(q, t):
        return t.str.len().astype(float)

    def first_is_best(q, t):
        return t.str.len() + (t.index == 0)

    assert rescoring.shuffle_invariance(pairs, ["id"], honest).first().holds
    got = rescoring.shuffle_invariance(pairs, ["id"], first_is_best).first()
    assert not got.holds and got.n_dependent > 0 and got.largest == 1
    first_is_best.listwise = True
    with pytest.raises(ListwiseScorerError):
        rescoring.order_dependence(pairs, ["id"], first_is_best)


def test_a_study_runs_only_what_changed(spark, tmp_path):
    t = spark.range(5).toDF("x")
    calls = []

    def step(name, f):
        def make(*dfs):
            calls.append(name)
            return f(*dfs)

        return make

    def study(version=1):
        return runner.Study(spark, str(tmp_path / "s"), Settings(), [runner.Step("double", ("t",), step("double", lambda d: d.select((F.col("x") * 2).alias("x"))), version), runner.Step("sum", ("double",), step("sum", lambda d: d.agg(F.sum("x").alias("x")))), runner.Step("n", ("t",), step("n", lambda d: d.agg(F.count("x").alias("x"))))])

    assert study().run(t=t) == {"double": True, "sum": True, "n": True}
    assert study().run(t=t.repartition(3)) == {"double": False, "sum": False, "n": False}
    assert study(2).run(t=t) == {"double": True, "sum": True, "n": False}
    assert study(2).run(t=t.union(t)) == {"double": True, "sum": True, "n": True}
    assert study().table("sum").first().x == 40 and calls == ["double", "sum", "n", "double", "sum", "double", "sum", "n"]
    with pytest.raises(InputError, match="has not been run"):
        study().table("other")
    with pytest.raises(InputError, match="no input"):
        study().run()


def test_steps_wait_for_what_they_read_only(spark, tmp_path):
    """Two tables are written at a time; a step that fails leaves the others' commits, and the study goes on from them."""
    from threading import Barrier

    met, t = Barrier(2, timeout=60), spark.range(4).toDF("x")

    def write_meets(df):
        class Waiting:
            @property
            def write(self):
                met.wait()  # passes only once the other step's table is being written too
                return df.write

        return Waiting()

    steps = [runner.Step("a", ("t",), write_meets), runner.Step("b", ("t",), write_meets), runner.Step("c", ("a", "b"), lambda a, b: a.union(b))]
    own = runner.Study(spark, str(tmp_path / "s"), Settings(), steps)
    assert own.run(t=t) == {"a": True, "b": True, "c": True} and own.table("c").count() == 8
    broken = [steps[0], runner.Step("bad", ("t",), lambda d: d.select(F.raise_error(F.lit("no")).alias("x"))), steps[1], runner.Step("e", ("t",), lambda d: d)]
    with pytest.raises(Exception, match="no"):
        runner.Study(spark, own.path, Settings(), broken).run(t=t)
    assert own.table("e").count() == 4
    with pytest.raises(InputError, match="has not been run"):
        own.table("bad")


def test_average_ranks_of_large_groups(spark):
    rng = np.random.default_rng(2)
    rows = [("g" if i % 3 else "h", i, float(rng.integers(0, 9)) * (i % 2), None if i % 50 == 0 else float(rng.normal())) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, i long, a double, b double")
    got = S.average_ranks(df, {"ra": "a", "rb": "b"}, ["k"], ranges=7).toPandas()
    for g, own in got.groupby("k"):
        assert (own["ra"] == own["a"].rank()).all() and np.allclose(own["rb"], own["b"].rank(), equal_nan=True), g


def test_study_commands(spark, tmp_path, capsys):
    """Cells, study, compare and outsiders by command line; what has not changed is not run again."""
    c = event_cascade(spark, "/root/testdata/sf0.001")
    (tmp_path / "y").write_text("candidate_depths: [10]\ndepth_m: 60\nk: 5\nother_cutoffs: []\nother_utilities: []\npolicies: [boundary]\n")
    s = config.load(str(tmp_path / "y"))
    rows = grid.effect_grid(c, s, "value").unionByName(grid.effect_grid(event_cascade(spark, "/root/testdata/sf0.001", True), s, "mix"))
    rows.where("stage1_system = 'value'").write.parquet(str(tmp_path / "one"))
    rows.write.parquet(str(tmp_path / "both"))
    contracts.save(event_qrels(spark, "/root/testdata/sf0.001"), str(tmp_path / "q"), "qrels")

    def run(*args):
        assert cli.main(["--settings", str(tmp_path / "y"), *map(str, args)]) == 0
        return json.loads(capsys.readouterr().out.strip().split("\n")[-1])

    study = ("study", "--effects", tmp_path / "one", "--out", tmp_path / "s", "--draws", 5, "--permutations", 9)
    assert all(run(*study).values()) and not any(run(*study).values())
    assert all(run("compare", "--effects", tmp_path / "both", "--first", "value", "--second", "mix", "--out", tmp_path / "c").values())
    assert all(run("outsiders", "--effects", tmp_path / "one", "--qrels", tmp_path / "q", "--out", tmp_path / "o").values())
    metrics = {r.metric for r in runner.Study(spark, str(tmp_path / "c"), s, []).table("one_axis").collect()}
    assert {"g_q_mean", "delta_boundary_t0.5"} <= metrics


def test_ingestion_commands(spark, tmp_path, capsys):
    """Text files to first-stage tables by command line; what is stale, shallow or unknown is refused."""
    (tmp_path / "y").write_text("sources: [bm25, other]\noptional_sources: []\nstage1_systems: [bm25]\npolicies: [boundary]\ndepth_m: 2\ncandidate_depths: [1]\nk: 1\nother_cutoffs: []\n")
    s = config.load(str(tmp_path / "y"))
    (tmp_path / "q").write_text("".join(f"q{i}\tred {'fish' if i else 'bird'}\n" for i in range(10)) + "\n")
    (tmp_path / "j").write_text("q0 0 a 3\nq1 0 b 0\n")
    spark.createDataFrame([("a", "red bird"), ("b", "a fish"), ("c", "blue"), ("d", "red red")], "doc_id string, text string").write.parquet(str(tmp_path / "texts"))
    stored = spark.createDataFrame([("q0", "c", "old", 1, 5.0, "v1"), ("q0", "d", "old", 2, 4.0, "v1")], "query_id string, doc_id string, system string, rank long, score double, checkpoint string")
    contracts.save(stored, str(tmp_path / "stored"), "run")
    out = tmp_path / "all"

    def run(*args):
        assert cli.main(["--settings", str(tmp_path / "y"), *map(str, args)]) == 0
        return json.loads(capsys.readouterr().out.strip().split("\n")[-1])

    prepare = ("prepare", "--queries", tmp_path / "q", "--qrels", tmp_path / "j", "--out", out)
    made = run(*prepare)
    assert made["n_queries"] == 10 and made["queries_without_judgment"] == 8 and made["split_sizes"] == {"train": 5, "val": 2, "test": 3}
    chain = ingest.Ingestion(spark, str(out), s)
    want = config.split_queries([f"q{i}" for i in range(10)], s.split_fractions, s.seed)
    assert {(r.query_id, r.split) for r in chain.split().collect()} == {(q, part) for part, ids in want.items() for q in ids}
    with pytest.raises(ValueError, match="whose depth is 2"):
        cli.main(["--settings", str(tmp_path / "y"), "retrieve", "--system", "bm25", "--corpus", str(tmp_path / "texts"), "--depth", "1", "--out", str(out)])
    first = run("retrieve", "--system", "bm25", "--corpus", tmp_path / "texts", "--out", out)
    assert first["n_rows"] == 20 and not first["shallow"] and first["depth_median"] == 2
    with pytest.raises(ValueError, match="run:other"):
        chain.freeze()
    other = run("retrieve", "--system", "other", "--from-run", tmp_path / "stored", "--out", out)
    assert other["without_answer"] == 9 and other["shallow"] == 9 and other["checkpoint"] == "v1"
    frozen = run("freeze", "--out", out)
    assert frozen["universe"]["size_max"] == 3 and frozen["stage1"]["bm25"]["n_floored"] == 1
    table = {(r.query_id, r.doc_id): r.rank for r in chain.stage1("bm25").collect()}
    assert table["q0", "a"] == 1 and table["q0", "c"] == 3 and len(table) == frozen["universe"]["n_pairs"] == 21
    contracts.save(chain.universe(), str(tmp_path / "u"), "universe")
    plan = run("shards", "--universe", tmp_path / "u", "--out", tmp_path / "p", "--shards", 2)
    assert plan == {"0": {"queries": 5, "pairs": 11}, "1": {"queries": 5, "pairs": 10}}
    run("retrieve", "--system", "other", "--from-run", tmp_path / "stored", "--out", out)
    with pytest.raises(ValueError, match="older results"):
        chain.universe()
    contracts.save(stored.withColumn("query_id", F.lit("nobody")), str(tmp_path / "strange"), "run")
    with pytest.raises(ValueError, match="not asked"):
        chain.retrieve("other", stored=contracts.load(spark, str(tmp_path / "strange"), "run"))
    (tmp_path / "j").write_text("q0 0 a 9\n")
    with pytest.raises(ValueError, match=r"no gain for grades \[9\]"):
        chain.prepare(str(tmp_path / "q"), str(tmp_path / "j"))
    with pytest.raises(ValueError, match="was begun with"):
        ingest.Ingestion(spark, str(out), config.Settings())


def test_merge_command(spark, tmp_path, capsys):
    stores(spark, tmp_path, one={"a": 1.0}, two={"b": 2.0})
    contracts.save(spark.createDataFrame([("q", "a", "s"), ("q", "b", "s")], "query_id string, doc_id string, sources string"), str(tmp_path / "u"), "universe")
    args = ["merge", "--universe", str(tmp_path / "u"), "--model", "m", "--out", str(tmp_path / "merged"), *(x for o in ("one", "two") for x in ("--shard", f"{o}={tmp_path / o}"))]
    assert cli.main(args) == 0
    said = json.loads(capsys.readouterr().out.strip().split("\n")[-1])
    assert said["complete"] and said["merged"] == 2 and set(said["owners"]) == {"one", "two"}


def test_a_shard_is_encoded_by_several_tasks(spark, tmp_path):
    import numpy as np
    from pyspark import TaskContext

    from tributary.sources import embeddings, vector_format

    texts = spark.range(200).selectExpr("cast(id as string) AS doc_id", "repeat('x', int(id)) AS text")
    embeddings.encode_shards(spark, str(tmp_path / "v"), texts, lambda ts: np.eye(8)[[TaskContext.get().partitionId() % 8] * len(ts)], "task", shard_rows=1000)
    back = spark.read.format(vector_format.FORMAT).load(str(tmp_path / "v"))
    assert back.count() == 200 and back.select("shard").distinct().count() == 1 and back.select("vector").distinct().count() > 1


@pytest.fixture(scope="module")
def late(spark, tmp_path_factory):
    """The smallest events with ids beyond ten million, of which the SQL shows seven digits."""
    folder = tmp_path_factory.mktemp("late")
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.withColumn("event_id", F.col("event_id") + 10_000_000).write.parquet(str(folder / "events.parquet"))
    keys = event_cascade(spark, str(folder)).groupBy("query_id", "doc_id").count().where("count > 1")
    assert keys.count() > 100
    return str(folder)


@pytest.mark.parametrize("name", ["grid_cells", "grid_read", "contract_effect", "contract_qrels", "contract_run", "stored_run", "ingest_universe", "ingest_stage1", "ingest_split"])
def test_ids_beyond_seven_digits(spark, late, name):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{late}/events.parquet/*.parquet'")
    duck.sql("CREATE VIEW benchmark AS SELECT * FROM '/root/testdata/sf0.001/benchmark.parquet'")
    if name == "ingest_split":
        (pathlib.Path(late) / "benchmark.parquet").symlink_to("/root/testdata/sf0.001/benchmark.parquet")
    got, want = catalog.QUERIES[name](spark, late), duck.sql(catalog.ORACLES[name])
    assert normal(map(tuple, got.collect()), got.columns) == normal(want.fetchall(), want.columns)


def test_whole_ids_keep_the_order(spark, late):
    rows = event_cascade(spark, late, whole=True).orderBy("doc_id").select("doc_id", F.substring("doc_id", 1, 8).alias("s")).collect()
    assert len({r.doc_id for r in rows}) == 1000 and [r.s for r in rows] == sorted(r.s for r in rows)


def test_a_grid_of_repeated_documents_is_refused(spark, tmp_path):
    c = event_cascade(spark, "/root/testdata/sf0.001")
    s = Settings(candidate_depths=(10,), depth_m=60, k=5, other_cutoffs=(), other_utilities=(), policies=("boundary",))
    with pytest.raises(ContractError, match="repeated key': 15"):
        grid.write_cells(c.unionByName(c.where("alt_rank = 40")), s, "value", str(tmp_path / "g"))


def test_a_cell_that_lost_doubled_or_changed_rows_is_refused(spark, tmp_path):
    c = event_cascade(spark, "/root/testdata/sf0.001")
    own = [Utility("dcg", 5)]
    rows = effects.stage_effects(worlds.build_worlds(c, [10], [False, True]), own, "value")
    held = {m: content(c.where("judged") if m else c, "query_id", "doc_id").first() for m in (False, True)}
    n = held[False].rows + held[True].rows
    assert grid._checked(rows, "cell", own, held) == 2 * n
    one = rows.where("query_id = 'q01' and rank_control = 1 and effect_type = 'e_gate' and not condensed")
    for wrong in (rows.exceptAll(one), rows.unionByName(one), rows.exceptAll(one).unionByName(one.withColumn("doc_id", F.lit("d9"))), rows.exceptAll(one).unionByName(one.withColumn("doc_id", F.lit(None).cast("string")))):
        with pytest.raises(ContractError, match="not those of documents|'rows'"):
            grid._checked(wrong, "cell", own, held)
    with pytest.raises(ContractError, match="definition"):
        grid._checked(rows.withColumn("effect", F.col("effect") + 1), "cell", own, held)
    with pytest.raises(ContractError, match="null stage1_system"):
        grid._checked(rows.withColumn("stage1_system", F.lit(None).cast("string")), "cell", own, held)
