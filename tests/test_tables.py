import pytest
from pyspark.sql import functions as F

from tributary import config, contracts
from tributary.errors import ConfigError, ContractError, InputError, MissingScoreError, PassageError, UniverseError
from tributary.operators import features, judgments, synthetic, universe, worlds
from tributary.sources import retrieval, trec
from tributary.sources.score_store import ScoreStore, plan_shards, shard_plan
from tributary.streaming import score_ingest


def run(spark, rows):
    return spark.createDataFrame([(q, d, s, r, float(10 - r), "v1") for q, s, ds in rows for r, d in enumerate(ds, 1)], contracts.SCHEMAS["run"])


def test_contracts(spark, tmp_path):
    good = run(spark, [("q1", "a", "xyz"), ("q1", "b", "yw")])
    contracts.save(good.withColumn("extra", F.lit(1)), str(tmp_path / "run"), "run")
    assert contracts.load(spark, str(tmp_path / "run"), "run").columns == good.columns
    with pytest.raises(ContractError, match="gaps"):
        contracts.validate(good.where("rank <> 2 or system = 'b'"), "run")
    with pytest.raises(ContractError, match="repeated"):
        contracts.validate(good.union(good), "run")
    with pytest.raises(ContractError, match="missing columns"):
        contracts.validate(good.drop("score"), "run")
    with pytest.raises(Exception, match="does not fit"):
        contracts.coerce(good.withColumn("rank", F.lit("x")), "run").collect()
    judged = spark.createDataFrame([("q", "d", None, True)], contracts.SCHEMAS["qrels"])
    with pytest.raises(ContractError, match="judged without grade"):
        contracts.validate(judged, "qrels")
    assert contracts.empty(spark, "effect").count() == 0


def test_universe(spark):
    r = run(spark, [("q1", "a", "wxyz"), ("q1", "b", "zuvw")])
    u = universe.build(r, 2)
    assert {x.doc_id: x.sources for x in u.collect()} == {"w": "a", "x": "a", "z": "b", "u": "b"}
    assert universe.escapes(r, u, 3).count() == 2
    with pytest.raises(UniverseError):
        universe.require_contained(r, u, 3)
    o = universe.overlap(r, "a", "b", 4).first()
    assert (o.n_both, o.n_only_first, o.n_only_second, o.jaccard) == (2, 2, 2, pytest.approx(1 / 3))
    f = {x.doc_id: x.score for x in universe.floored(r.where("rank <= 2"), "a", u).collect()}
    assert f == {"w": 9, "x": 8, "z": 7, "u": 7}
    assert universe.reference_subset(u, 5) == ["q1"]


def test_judgments_stay_unknown(spark):
    u = spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, doc_id string")
    q = spark.createDataFrame([("q", "a", 0, True), ("q", "z", 3, True)], contracts.SCHEMAS["qrels"])
    assert {r.doc_id: (r.relevance, r.judged) for r in judgments.attach(u, q).collect()} == {"a": (0, True), "b": (None, False)}


def test_text_sources(spark, tmp_path):
    (tmp_path / "qrels").write_text("q1 0 d1 3\n\nq1 0 d2 0\n")
    assert trec.read_qrels(spark, str(tmp_path / "qrels")).count() == 2
    (tmp_path / "bad").write_text("q1 0 d1\n")
    with pytest.raises(InputError):
        trec.read_qrels(spark, str(tmp_path / "bad"))
    (tmp_path / "queries").write_text("q1\twhat is it\nq2\ta \"quoted\" one\n")
    assert {r.query_id: r.text for r in trec.read_queries(spark, str(tmp_path / "queries")).collect()}["q2"] == 'a "quoted" one'
    (tmp_path / "twice").write_text("q1\ta\nq1\tb\n")
    with pytest.raises(InputError, match="twice"):
        trec.read_queries(spark, str(tmp_path / "twice"))
    corpus = spark.createDataFrame([("d1", "x")], "doc_id string, text string")
    with pytest.raises(PassageError):
        trec.passages(corpus, spark.createDataFrame([("d2",)], "doc_id string"))


def test_score_store_and_stream(spark, tmp_path):
    store, other = ScoreStore(spark, str(tmp_path / "s")), ScoreStore(spark, str(tmp_path / "o"))
    cols = "query_id string, doc_id string, model string, score double"
    store.put(spark.createDataFrame([("q", "a", "m", 1.0), ("q", "b", "m", 2.0)], cols), 1)
    store.put(spark.createDataFrame([("q", "a", "m", 5.0)], cols), 2)
    other.put(spark.createDataFrame([("q", "c", "m", 3.0), ("q", "c", "n", 3.0)], cols), 1)
    for _ in range(2):
        store.merge_from(other, "m")
    assert {r.doc_id: r.score for r in store.scores("m").collect()} == {"a": 5, "b": 2, "c": 3}
    assert store.models() == ["m"]
    u = spark.createDataFrame([("q", d) for d in "abcd"], "query_id string, doc_id string")
    with pytest.raises(MissingScoreError):
        store.require_complete(u, "m")
    store.fill(u, "m", lambda pairs: pairs.withColumn("score", F.lit(0.5)))
    store.require_complete(u, "m")
    spark.createDataFrame([("q", "z", "m", 9.0)], cols).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cols).parquet(str(tmp_path / "in"))
    for _ in range(2):
        score_ingest.ingest(stream, store, str(tmp_path / "cp")).awaitTermination()
    assert store.count("m") == 5
    with pytest.raises(Exception, match="a score is missing"):
        store.put(spark.createDataFrame([("q", "a", "m", None)], cols))


def test_shards_are_even(spark):
    u = spark.createDataFrame([(f"q{i}", f"d{j}") for i in range(6) for j in range(i + 1)], "query_id string, doc_id string")
    load = {}
    for s, _, n in shard_plan(u, 3):
        load[s] = load.get(s, 0) + n
    assert load == {0: 7, 1: 7, 2: 7}


@pytest.mark.parametrize("shards", [1, 3, 7])
def test_shards_are_those_of_one_query_after_the_other(spark, shards):
    size = {f"q{i:03d}": 1 + (i * i) % 11 if i % 3 else 4 for i in range(90)}
    u = spark.createDataFrame([(q, f"d{j}") for q, n in size.items() for j in range(n)], "query_id string, doc_id string")
    load, want = [0] * shards, {}
    for q in sorted(size, key=lambda q: (-size[q], q)):
        want[q] = min(range(shards), key=lambda i: (load[i], i))
        load[want[q]] += size[q]
    assert {r.query_id: r.shard for r in plan_shards(u, shards, ranges=5).collect()} == want
    assert not plan_shards(u.limit(0), shards).collect()


def test_settings():
    s = config.Settings()
    assert s.fingerprint == config.Settings().fingerprint and s.budget_for(100) == 100
    for bad in ({"k": 500}, {"t_grid": (0.5,)}, {"depth_m": 900}, {"gains": {0: 3.0, 1: 0.0}}, {"unjudged": "irrelevant"}, {"stage1_systems": ("bm25", "other")}, {"granularity": "document"}, {"reference_size": 1}):
        with pytest.raises(ConfigError):
            config.Settings(**bad)
    parts = config.split_queries([f"q{i}" for i in range(97)], s.split_fractions, 42)
    assert sorted(len(v) for v in parts.values()) == [19, 29, 49] and len({q for v in parts.values() for q in v}) == 97
    a = config.manifest(s, "me")
    assert config.same_freeze(a, a) == s.fingerprint
    with pytest.raises(ConfigError):
        config.same_freeze(a, {"fingerprint": "other"})


def test_features_read_only_candidates_scores(spark):
    c = synthetic.generate(spark, synthetic.Regime(0.8, 0.9, 0.3, 0.2), 3, 60)
    inside = features.wide(worlds.build_worlds(c, [10]), 5, 30)
    order = c.withColumn("r", F.expr("row_number() over (partition by query_id order by s1 desc, doc_id)"))
    moved = order.withColumn("s2", F.when(F.col("r") > 10, F.col("s2") + 100).otherwise(F.col("s2"))).drop("r")
    again = features.wide(worlds.build_worlds(moved, [10]), 5, 30)
    assert sorted(map(str, inside.collect())) == sorted(map(str, again.collect()))
    assert features.pivot(features.long(inside)).count() == inside.count()


def test_features_of_a_query_span_tasks(spark):
    """The scores at the cuts are joined to the rows; a condensed gate whose last document is unjudged has none."""
    rows = spark.range(400).select(F.lit("q").alias("query_id"), F.format_string("d%03d", "id").alias("doc_id"), (-F.col("id")).cast("double").alias("s1"), (F.col("id") % 7).cast("double").alias("s2"), (F.col("id") + 1).cast("int").alias("alt_rank"), F.lit(1).cast("long").alias("relevance"), (F.col("id") != 9).alias("judged"))
    got = features.wide(worlds.build_worlds(rows, [10, 20], [False, True]), 5, 30)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2 * 400 + 2 * 399 and max(sizes) < sum(sizes) / 2
    cuts = {(r.k_c, r.n, r.s1_cut, r.s2_cut) for r in got.groupBy("k_c", F.col("s1_margin").isNull().alias("none")).agg(F.count(F.lit(1)).alias("n"), F.max(-F.substring("doc_id", 2, 3).cast("double") - F.col("s1_margin")).alias("s1_cut"), F.max(F.col("s2_score") - F.col("s2_margin_k")).alias("s2_cut")).collect()}
    assert cuts == {(10, 400, -9.0, 2.0), (10, 399, None, 2.0), (20, 799, -19.0, 5.0)}


def test_keys_are_dealt_out_before_they_are_counted(spark, monkeypatch):
    """A task of the check holds KEY_ROWS rows or so, whatever adaptive execution joins; a constant key changes nothing."""
    monkeypatch.setattr(contracts, "KEY_ROWS", 250)
    one = spark.range(1000).select(F.lit("q").alias("query_id"), F.format_string("d%04d", "id").alias("doc_id"), F.lit("v1").alias("feature_version"), F.lit("f").alias("feature_name"), F.lit(0.0).alias("value"), F.lit(0.0).alias("generation_seconds"))
    twice = contracts.repeated(one.union(one), contracts.KEYS["feature"], 2000)
    sizes = [r["count"] for r in twice.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1000 and max(sizes) < 250
    assert twice._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert contracts.problems(one.union(one.limit(3)), "feature") == {"repeated key": 3} and contracts.problems(one, "feature") == {}


def test_stress_moves_what_it_should(spark):
    c = synthetic.generate(spark, synthetic.Regime(0.8, 0.9, 0.3, 0.2), 2, 80)
    gated = synthetic.gate_stress(c, 10, 3)
    moved = c.join(gated.select("query_id", "doc_id", F.col("s1").alias("t")), ["query_id", "doc_id"]).where("s1 <> t")
    assert 0 < moved.count() <= 6 and moved.where("relevance = 0").count() == 0
    lifted = worlds.build_worlds(synthetic.budget_stress(c, 10, 4), [10])
    assert lifted.where("rank_c <= 4 and not in_cq").count() == 8


def test_ridge_is_the_closed_form(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2))
    y = x @ [1.5, -2.0] + rng.normal(size=60)
    df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x, y, strict=True)], "a double, b double, effect double")
    got = np.array([r.prediction for r in features.fit_predict(df, df, ["a", "b"], "ridge", 1.0).orderBy("a").collect()])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    w = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean()))
    assert np.allclose(got, (z @ w + y.mean())[np.argsort(x[:, 0])], atol=1e-6)


def test_retrievers(spark):
    q = spark.createDataFrame([("q1", "red apple")], "query_id string, text string")
    d = spark.createDataFrame([("d1", "red red apple"), ("d2", "green pear"), ("d3", "apple pie crust"), ("d4", None)], "doc_id string, text string")
    got = {r.doc_id: r.score for r in retrieval.bm25(q, d).collect()}
    assert set(got) == {"d1", "d3"} and got["d1"] > got["d3"]
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8])], "doc_id string, vector array<double>")
    s = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<double>")
    assert [(r.doc_id, r.rank) for r in retrieval.exact_search(s, v, 1).collect()] == [("a", 1)]
    with pytest.raises(InputError):
        retrieval.stored_run(run(spark, [("q", "a", "x")]), "other")


def test_many_queries_pass_on_few_pairs():
    """A block of more queries than a product has room for is cut by queries, so documents that cannot win stay."""
    import numpy as np
    import pyarrow as pa

    from tributary.sources import retrieval

    rng = np.random.default_rng(1)
    asked, x = rng.normal(size=(50_000, 4)), rng.normal(size=(600, 4))
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(600)]), pa.array(list(x))], names=["doc_id", "vector"])
    shared = type("Shared", (), {"value": ([str(i) for i in range(len(asked))], asked)})
    got = list(retrieval._nearest(shared, 4, 101)(iter([batch])))
    assert sum(b.num_rows for b in got) == 101 * len(asked) and max(b.num_rows for b in got) <= retrieval.PRODUCT // 4
