"""Can a study's questions be answered on given runs and judgments? Tables and a verdict."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import judgments


def leverage(runs: DataFrame, systems: Sequence[str], depths: Sequence[int]) -> DataFrame:
    """Overlap of two systems' candidate sets at each depth, in one pass over the runs."""
    first, second = systems[:2]
    top = runs.where(F.col("system").isin(first, second)).withColumn("k_c", F.explode(F.array(*map(F.lit, depths)))).where("rank <= k_c")
    docs = top.groupBy("query_id", "k_c", "doc_id").agg(F.max((F.col("system") == first).cast("int")).alias("a"), F.max((F.col("system") == second).cast("int")).alias("b"))
    got = docs.groupBy("query_id", "k_c").agg(F.sum(F.col("a") * F.col("b")).alias("n_both"), F.count(F.lit(1)).alias("n_either"))
    return got.withColumn("jaccard", F.try_divide(F.col("n_both").cast("double"), F.col("n_either")))


def outside(runs: DataFrame, qrels: DataFrame, gain, systems: Sequence[str], depths: Sequence[int]) -> DataFrame:
    """Judged and gainful documents outside each candidate set, by system, depth and query."""
    parts = [judgments.judged_outside(qrels, runs.where((F.col("system") == s) & (F.col("rank") <= d)), gain).select(F.lit(s).alias("system"), F.lit(d).alias("k_c"), "*") for s in systems for d in depths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def verdict(lever: DataFrame, outs: DataFrame, least_outside: int = 5, most_jaccard: float = 0.9) -> DataFrame:
    """Per depth and system: medians, and whether the gate can be told apart there."""
    a = lever.groupBy("k_c").agg(F.median("jaccard").alias("median_jaccard"))
    b = outs.groupBy("k_c", "system").agg(F.median("n_outside_relevant").alias("median_outside_relevant"), F.sum("n_outside_relevant").alias("outside_relevant"))
    return b.join(a, "k_c").withColumn("usable", (F.col("outside_relevant") >= least_outside) & (F.col("median_jaccard") <= most_jaccard))


#: Names and limits of the findings. How many times denser judgments may lie among candidates than in the universe, or
#: in one system's candidates than in another's; gainful documents that the median query has outside the gate;
#: overlap of two systems' candidates.
MOST_DENSITY_RATIO, LEAST_GAINFUL, MOST_OVERLAP = 3.0, 1.0, 0.8
FINDINGS = {
    "judgment_placement": "judged documents lie far more densely among the candidates than in the universe, so a world without a gate is judged less well",
    "gate_failure_supply": "the median query has too few gainful documents outside the gate for a failure to be seen",
    "between_system_asymmetry": "one system's candidates are judged far more densely than another's, so systems differ by judgments alone",
    "no_leverage": "two systems select nearly the same candidates",
    "no_usable_depth": "at no depth every system has supply and the systems differ",
}


def placement(runs: DataFrame, uni: DataFrame, qrels: DataFrame, systems: Sequence[str], depths: Sequence[int]) -> DataFrame:
    """(system, k_c, query_id, density_cq, density_uq, density_ratio): judged shares of candidates and universe."""
    key = ["query_id", "doc_id"]
    judged = qrels.where(F.coalesce("judged", F.lit(False))).select(*key).distinct().withColumn("hit", F.lit(1))
    share = F.count("hit") / F.count(F.lit(1))
    whole = uni.select(*key).distinct().join(judged, key, "left").groupBy("query_id").agg(share.alias("density_uq"))
    top = runs.where(F.col("system").isin(*systems)).withColumn("k_c", F.explode(F.array(*map(F.lit, depths)))).where("rank <= k_c")
    got = top.select("system", "k_c", *key).join(judged, key, "left").groupBy("system", "k_c", "query_id").agg(share.alias("density_cq")).join(whole, "query_id", "left")
    return got.select("system", "k_c", "query_id", "density_cq", "density_uq", F.try_divide("density_cq", "density_uq").alias("density_ratio"))


def findings(lever: DataFrame, outs: DataFrame, placed: DataFrame, most_ratio: float = MOST_DENSITY_RATIO, least_gainful: float = LEAST_GAINFUL, most_overlap: float = MOST_OVERLAP) -> DataFrame:
    """(finding, k_c, system, value): each kind of problem and where it is, from :func:`leverage`,
    :func:`outside` and :func:`placement`.

    Medians are over queries. ``system`` is null for what concerns a depth, and k_c as well for
    ``no_usable_depth``. Systems are never pooled. FINDINGS says what each means.
    """
    none = F.lit(None).cast("string")
    supply = outs.groupBy("k_c", "system").agg(F.median("n_outside_relevant").cast("double").alias("value"))
    dense = placed.groupBy("k_c", "system").agg(F.median("density_ratio").alias("ratio"), F.median("density_cq").alias("density"))
    overlap = lever.groupBy("k_c").agg(F.median("jaccard").alias("value"))
    uneven = dense.groupBy("k_c").agg(F.count(F.lit(1)).alias("n"), F.min("density").alias("lo"), F.max("density").alias("hi")).where("n > 1")
    uneven = uneven.select("k_c", F.when(F.col("lo") > 0, F.col("hi") / F.col("lo")).otherwise(F.when(F.col("hi") > 0, F.lit(float("inf")))).alias("value"))
    usable = supply.groupBy("k_c").agg(F.min("value").alias("least")).where(F.col("least") >= least_gainful)
    parts = [
        dense.where(F.col("ratio") > most_ratio).select(F.lit("judgment_placement").alias("finding"), "k_c", "system", F.col("ratio").alias("value")),
        supply.where(F.col("value") < least_gainful).select(F.lit("gate_failure_supply").alias("finding"), "k_c", "system", "value"),
        uneven.where(F.col("value") > most_ratio).select(F.lit("between_system_asymmetry").alias("finding"), "k_c", none.alias("system"), "value"),
        overlap.where(F.col("value") > most_overlap).select(F.lit("no_leverage").alias("finding"), "k_c", none.alias("system"), "value"),
        usable.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("no_usable_depth").alias("finding"), F.lit(None).cast("int").alias("k_c"), none.alias("system"), F.lit(0.0).alias("value")),
    ]
    return reduce(DataFrame.unionByName, parts)


def headline_depth(verdicts: DataFrame) -> int | None:
    """Among depths usable for every system, that with most supply for the weakest one; ties go deeper."""
    best = verdicts.groupBy("k_c").agg(F.min("usable").alias("usable"), F.min("outside_relevant").alias("supply")).where("usable").orderBy(F.desc("supply"), F.desc("k_c")).first()
    return best.k_c if best else None


def policy_supply(runs: DataFrame, uni: DataFrame, system: str, other: str, depths: Sequence[int]) -> DataFrame:
    """Per depth: least and median number of outsiders that each policy can choose from."""
    own = uni.select("query_id", "doc_id").join(runs.where(F.col("system") == system).select("query_id", "doc_id", F.col("rank").alias("r")), ["query_id", "doc_id"], "left").join(runs.where(F.col("system") == other).select("query_id", "doc_id", F.col("rank").alias("o")), ["query_id", "doc_id"], "left")
    got = own.withColumn("k_c", F.explode(F.array(*map(F.lit, depths)))).where("r is null or r > k_c").groupBy("query_id", "k_c").agg(F.count("r").alias("ranked"), F.count("o").alias("by_other"))
    return got.groupBy("k_c").agg(F.min("ranked").alias("least_ranked"), F.median("ranked").alias("median_ranked"), F.min("by_other").alias("least_by_other"), F.median("by_other").alias("median_by_other"), F.min((F.col("by_other") >= F.col("k_c")).cast("int")).alias("enough"))


def effectiveness(ranked: DataFrame, qrels: DataFrame, published: dict[str, float], tolerance: float = 0.01, k: int = 10, depth: int = 1000) -> DataFrame:
    """Mean ndcg and recall over judged queries against published values; a missing query counts 0."""
    from ..functions.utility import ndcg, recall

    n = ndcg(ranked, qrels, k).agg(F.avg("ndcg").alias("ndcg"))
    r = recall(ranked, qrels, depth).agg(F.avg("recall").alias("recall"))
    both = n.join(F.broadcast(r))  # one row each
    long = both.unpivot([], ["ndcg", "recall"], "metric", "value")
    want = F.coalesce(*[F.when(F.col("metric") == m, F.lit(v)) for m, v in published.items()], F.lit(None).cast("double"))
    return long.withColumn("published", want).withColumn("agrees", F.abs(F.col("value") - F.col("published")) <= tolerance)


