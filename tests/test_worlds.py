import math

import pytest
from pyspark.sql import functions as F

from tests import toy
from tributary import names as N
from tributary.functions.utility import Utility
from tributary.operators import allocation, effects, ranking, summaries, worlds

U = Utility("dcg", toy.K)


def order(df, rank):
    return [r.doc_id for r in df.where(F.col(rank).isNotNull()).orderBy(rank).collect()]


@pytest.fixture(scope="module")
def toy_worlds(spark):
    return worlds.build_worlds(toy.cascade(spark), [toy.K_C]).cache()


def test_worlds_by_hand(toy_worlds):
    assert order(toy_worlds, "rank_a") == list("bcda")
    assert order(toy_worlds, "rank_b") == list("abcd")
    assert order(toy_worlds, "rank_c") == list("ebicgdfjah")
    assert worlds.isolation_violations(toy_worlds).count() == 0


def test_effects_by_hand(toy_worlds):
    got = {(r.doc_id, r.effect_type): r.effect for r in effects.stage_effects(toy_worlds, U).collect()}
    assert got["a", N.E_RERANK] == -7
    assert got["e", N.E_GATE] == -7
    assert got["b", N.E_GATE] == pytest.approx(3 - 3 / math.log2(3))
    assert len(got) == 20


def test_budget_by_hand(spark, toy_worlds):
    grid = allocation.parameters(spark, [toy.K_C], [1.0, 0.75, 0.5], [N.BOUNDARY])
    got = allocation.allocate(toy_worlds, grid)
    half = {r.doc_id: r.stratum for r in got.where("t = 0.5").collect()}
    assert [d for d in "abcdefghij" if half[d] == N.RETAINED] == ["a", "b"]
    assert [d for d in "abcdefghij" if half[d] == N.REMOVED] == ["c", "d"]
    assert [d for d in "abcdefghij" if half[d] == N.SELECTED] == ["e", "f"]
    delta = {r.doc_id: r.effect for r in effects.budget_effects(got, U).where("t = 0.5").collect()}
    assert delta["e"] == pytest.approx(7)
    assert delta["b"] == pytest.approx(3 / math.log2(3) - 3)
    assert allocation.audit(got).where("not valid").count() == 0


def test_t_of_one_is_the_cascade(spark, toy_worlds):
    got = allocation.allocate(toy_worlds, allocation.parameters(spark, [toy.K_C], [1.0], [N.ALTERNATIVE]))
    assert order(got, "rank_t") == list("bcda")


def test_random_policy_is_numpys_choice(spark, toy_worlds):
    import numpy as np

    grid = allocation.parameters(spark, [toy.K_C], [1.0, 0.5], [N.RANDOM], [42, 43])
    got = allocation.allocate(toy_worlds, grid).where("t = 0.5")
    for seed in (42, 43):
        want = {"efghij"[i] for i in np.random.default_rng(seed).choice(6, size=2, replace=False)}
        assert {r.doc_id for r in got.where((F.col("seed") == seed) & (F.col("stratum") == N.SELECTED)).collect()} == want


@pytest.mark.parametrize("kind", ["dcg", "topk", "rbp"])
@pytest.mark.parametrize("k_c", [3, 5, 8])
def test_sign_rules_hold(spark, kind, k_c):
    rows = spark.range(400).select(
        F.concat(F.lit("q"), F.col("id") % 10).alias("query_id"), F.format_string("d%03d", F.col("id")).alias("doc_id"), F.rand(1).alias("s1"), F.rand(2).alias("s2"),
        (F.pmod(F.hash("id"), F.lit(40)) + 1).alias("alt_rank"), F.pmod(F.hash("id", F.lit(1)), F.lit(4)).cast("long").alias("relevance"), (F.rand(3) < 0.7).alias("judged"),
    ).withColumn("relevance", F.when(F.col("judged"), F.col("relevance"))).cache()
    u = Utility(kind, 5)
    both = worlds.build_worlds(rows, [k_c], [False, True])
    grid = allocation.parameters(spark, [k_c], [1.0, 0.75, 0.5], [N.BOUNDARY, N.ALTERNATIVE])
    full = allocation.allocate(worlds.build_worlds(rows, [k_c]), grid)
    every = effects.stage_effects(both, u).unionByName(effects.budget_effects(full, u)).unionByName(effects.budget_effects(allocation.condense(full), u))
    for r in effects.violations(every, u.monotone).collect():
        assert sum(r[c] for c in r.asDict() if c not in ("effect_type", "n")) == 0, r


def test_condensing_changes_nothing_when_all_is_judged(toy_worlds, spark):
    both = worlds.build_worlds(toy.cascade(spark), [toy.K_C], [False, True])
    a, b = (sorted((r.doc_id, r.rank_a, r.rank_b, r.rank_c) for r in both.where(f"condensed = {m}").collect()) for m in ("true", "false"))
    assert str(a) == str(b)


def test_diagnosis_adds_up(toy_worlds):
    d = summaries.diagnose(effects.stage_effects(toy_worlds, U)).first()
    act, no_gate, no_rerank = 3.0, 7 + 3 / math.log2(3), 7 + 3 / math.log2(3)
    assert (d.g_q, d.rerank_signed) == (pytest.approx(no_gate - act), pytest.approx(act - no_rerank))
    assert d.reranker_harms and d.label == N.RERANK_SENSITIVE  # a tie goes to reranking


def test_refusals(spark, toy_worlds):
    with pytest.raises(Exception, match="outside the gate"):
        worlds.build_worlds(toy.cascade(spark), [10]).count()
    gap = toy.cascade(spark).withColumn("s2", F.when(F.col("doc_id") != "c", F.col("s2")))
    with pytest.raises(Exception, match="s2 is missing for document c"):
        worlds.build_worlds(gap, [4]).select("rank_c").collect()
    with pytest.raises(Exception, match="no gain for grade 9"):
        effects.stage_effects(toy_worlds.withColumn("relevance", F.lit(9).cast("long")), U).select("effect").collect()
    with pytest.raises(Exception, match="no baseline"):
        effects.budget_effects(allocation.allocate(toy_worlds, allocation.parameters(spark, [4], [0.5], [N.BOUNDARY])), U).select("doc_id").collect()
    with pytest.raises(ValueError, match="candidates"):
        allocation.parameters(spark, [4], [1.0], [N.BOUNDARY], budget=9)


def test_order_does_not_depend_on_partitions(spark):
    c = toy.cascade(spark).withColumn("s1", F.lit(1.0))
    assert order(ranking.rank_by(c.repartition(7), "s1"), "rank") == order(ranking.rank_by(c.orderBy(F.desc("doc_id")), "s1"), "rank") == list("abcdefghij")


def test_ranks_in_ranges_are_the_same(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("q"), F.col("id") % 7)).alias("query_id"), F.format_string("d%05d", "id").alias("doc_id"), F.pmod(F.hash("id"), F.lit(50)).cast("double").alias("s1"))
    want = {(r.query_id, r.doc_id): r.rank for r in ranking.rank_by(rows, "s1").collect()}
    assert {(r.query_id, r.doc_id): r.rank for r in ranking.rank_in_ranges(rows, "s1", ranges=9).collect()} == want


def test_worlds_of_ranges_are_the_same(spark):
    c = toy.cascade(spark)
    other = c.withColumn("query_id", F.lit("other")).where("doc_id <> 'c'")
    rows = c.unionByName(other).withColumn("judged", F.when(F.col("doc_id") != "b", ~F.col("doc_id").isin("e", "j")))

    def built(ranges):
        got = worlds.build_worlds(rows, [toy.K_C, 2], [False, True], ranges)
        return {(r.query_id, r.doc_id, r.k_c, r.condensed): (r.in_cq, r.rank_a, r.rank_b, r.rank_c, r.n_docs) for r in got.collect()}

    assert built(5) == built(None) and len(built(5)) == 2 * (10 + 9 + 7 + 6)
    assert ranking.ranges_for(rows) is None and ranking.ranges_for(rows.limit(0)) is None


def test_allocations_of_ranges_are_the_same(spark):
    other = toy.cascade(spark).where("doc_id <> 'c'").withColumns({"query_id": F.lit("other"), "alt_rank": F.when(F.col("doc_id") > "d", F.col("alt_rank"))})
    rows = toy.cascade(spark).unionByName(other)
    grid = allocation.parameters(spark, [toy.K_C, 2], [1.0, 0.5, 0.0], N.POLICIES, [42, 43])

    def spent(ranges):
        got = allocation.allocate(worlds.build_worlds(rows, [toy.K_C, 2], ranges=ranges), grid, ranges).collect()
        return {(r.query_id, r.doc_id, r.k_c, r.policy, r.seed, r.t): (r.stratum, r.submitted, r.rank_t, r.rank_1, r.baseline) for r in got}

    assert spent(3) == spent(None) and len(spent(3)) == 19 * 2 * 3 * 4


def test_queries_too_large_for_a_task_are_dealt_into_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranking, "LARGE", 9)
    monkeypatch.setattr(ranking, "RANGE_ROWS", 4)
    assert ranking.ranges_for(toy.cascade(spark)) == 3


def test_condensed_allocations_recount_ranks_and_baselines(spark):
    rows = toy.cascade(spark).withColumn("judged", ~F.col("doc_id").isin("b", "e", "j"))
    grid = allocation.parameters(spark, [toy.K_C], [1.0, 0.5], [N.BOUNDARY, N.RANDOM], [42])
    full = allocation.allocate(worlds.build_worlds(rows, [toy.K_C]), grid)
    both = allocation.in_modes(full, [False, True]).collect()
    for condensed in (False, True):
        for policy, t in [(p, t) for p in (N.BOUNDARY, N.RANDOM) for t in (1.0, 0.5)]:
            own = [r for r in both if (r.condensed, r.policy, r.t) == (condensed, policy, t)]
            sent = sorted((r for r in own if r.submitted), key=lambda r: r.rank_s2)
            assert len(own) == (7 if condensed else 10)
            assert [r.rank_t for r in sent] == list(range(1, len(sent) + 1))
            assert all(r.rank_t is None for r in own if not r.submitted)
            first = sorted((r for r in own if r.in_cq), key=lambda r: r.rank_s2)
            assert [r.rank_1 for r in first] == list(range(1, len(first) + 1))
            assert all(r.rank_1 is None for r in own if not r.in_cq)


def test_no_task_multiplies_a_whole_query(spark):
    """One query's worlds and grid cells are spread over the tasks, and candidates alone are sorted again."""
    rows = spark.range(400).select(F.lit("q").alias("query_id"), F.format_string("d%03d", "id").alias("doc_id"), F.rand(1).alias("s1"), F.rand(2).alias("s2"), (F.col("id") + 1).cast("int").alias("alt_rank"), F.lit(1).cast("long").alias("relevance"), F.lit(True).alias("judged"))
    built = worlds.build_worlds(rows, [5, 9], [False, True])
    spent = allocation.allocate(worlds.build_worlds(rows, [5]), allocation.parameters(spark, [5], [1.0, 0.5], [N.BOUNDARY, N.ALTERNATIVE, N.RANDOM]))
    for df, n in ((built, 1600), (spent, 2400)):
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == n and max(sizes) < n / 2
