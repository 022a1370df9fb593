import math

import numpy as np
import pandas as pd
import pytest

from tributary.functions import special
from tributary.functions import statistics as S
from tributary.operators import resample


@pytest.mark.parametrize("rho, p", [(0.31741, 7.68e-4), (0.42507, 7.13e-6), (0.24687, 7.39e-3), (0.23150, 1.126e-2)])
def test_rank_correlation_tail(rho, p):
    assert special.spearman_p(rho, 97) == pytest.approx(p, rel=2e-3)


@pytest.mark.parametrize("only, of, one, two", [(13, 16, 0.0106, 0.0213), (15, 17, 0.00117, 0.00235)])
def test_exact_binomial(only, of, one, two):
    assert special.binomial_p(only, of) == pytest.approx(one, rel=0.01)
    assert special.binomial_p(only, of, two_sided=True) == pytest.approx(two, rel=0.01)


def test_permutation_floor_and_noise():
    rng = np.random.default_rng(0)
    assert resample.permutation_p(rng.normal(9, 0.1, 12), rng.normal(0, 0.1, 12), 999, rng) == 1 / 1000
    assert resample.permutation_p(rng.normal(size=20), rng.normal(size=20), 999, rng) > 0.05


def test_point_metrics_leave_gaps_and_constants_out(spark):
    rows = [("x", 1.0, 2.0), ("x", 2.0, 1.0), ("x", 3.0, 5.0), ("x", None, 1.0), ("x", float("nan"), 1.0), ("y", 1.0, 1.0), ("y", 1.0, 2.0), ("y", 1.0, 3.0)]
    got = {r.s: r for r in S.point_metrics(spark.createDataFrame(rows, "s string, p double, r double"), "p", "r", ["s"]).collect()}
    assert got["x"].n == 3 and got["x"].mae == pytest.approx(4 / 3) and got["x"].spearman == pytest.approx(0.5)
    assert got["y"].pearson is None and got["y"].spearman is None


def test_average_ranks():
    assert resample.ranks(np.array([3.0, 1.0, 3.0, 2.0])).tolist() == [3.5, 1, 3.5, 2]
    assert math.isnan(resample.spearman(np.ones(5), np.arange(5.0)))


def test_bootstrap_shares_its_draws(spark):
    rows = [(f"q{i}", float(i), float(i)) for i in range(20)]
    t = spark.createDataFrame([("g", *r) for r in rows], "g string, query_id string, a double, b double")
    got = {r.statistic: r for r in resample.bootstrap(t, ["g"], {"a": lambda p: p["a"].mean(), "b": lambda p: p["b"].mean()}, n=100).collect()}
    assert got["a"].lo == got["b"].lo < got["a"].point == 9.5 < got["a"].hi


def test_quantiles_of_large_groups(spark):
    """Ties, null values and null keys over many ranges agree with numpy; a group of one value is its quantiles."""
    rng = np.random.default_rng(3)
    rows = [(None if i % 3 == 0 else "g" if i % 3 == 1 else "h", 0.0 if rng.random() < 0.6 else float(rng.normal()), i) for i in range(700)]
    rows += [("one", 2.5, 0), ("one", None, 1), ("none", None, 2)]
    df = spark.createDataFrame(rows, "k string, x double, i long")
    shares = {"lo": 0.0, "a": 0.05, "m": 0.5, "b": 0.95, "hi": 1.0}
    for ranges in (1, 9):
        got = {r.k: r for r in S.quantiles(df, "x", shares, ["k"], ranges).collect()}
        assert set(got) == {None, "g", "h", "one"}
        for k, r in got.items():
            own = [x for key, x, _ in rows if key == k and x is not None]
            assert [r[n] for n in shares] == pytest.approx(np.quantile(own, list(shares.values())))
    whole = S.quantiles(df, "x", {"m": 0.5}, []).collect()
    assert len(whole) == 1 and whole[0].m == pytest.approx(np.median([x for _, x, _ in rows if x is not None]))
    assert S.quantiles(df.limit(0), "x", {"m": 0.5}, ["k"]).count() == 0


def test_point_metrics_of_large_groups(spark):
    """Ranks by ranges give the metrics that ranks by windows give, for a null key too."""
    rng = np.random.default_rng(4)
    rows = [("g" if i % 2 else None, float(rng.integers(0, 6)), None if i % 40 == 0 else float(rng.integers(0, 9)) + 0.5) for i in range(500)]
    df = spark.createDataFrame(rows, "s string, p double, r double")
    few, many = ({r.s: r.asDict() for r in S.point_metrics(df, "p", "r", ["s"], n).collect()} for n in (10_000, 3))
    assert set(few) == set(many) == {"g", None}
    for s in few:
        assert {k: v for k, v in many[s].items() if k != "s"} == pytest.approx({k: v for k, v in few[s].items() if k != "s"})


def test_rank_sums_of_groups_beyond_one_task(spark):
    """Ranks by ranges give the sums of ranks by windows, and no window takes a whole group."""
    rows = spark.range(400).selectExpr("'k' AS g", "concat('q', id % 7) AS query_id", "double(id % 13) AS p", "double(id % 5) AS x")
    one, many = (resample.rank_sums(rows, "p", "x", ["g"], most).orderBy("query_id").toPandas() for most in (1000, 10))
    pd.testing.assert_frame_equal(one, many)
