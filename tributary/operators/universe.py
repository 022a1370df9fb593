"""The universe of a query: the union of every source's best documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import UniverseError

KEY = ["query_id", "doc_id"]


def build(runs: DataFrame, depth: int, max_size: int | None = None) -> DataFrame:
    """(query_id, doc_id, sources) of documents in some system's top ``depth``.

    With ``max_size`` the documents of best rank in any system are kept, ties by doc_id.
    """
    top = runs.where(F.col("rank") <= depth)
    got = top.groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_set("system")), ",").alias("sources"), F.min("rank").alias("best_rank"))
    if max_size is not None:
        order = Window.partitionBy("query_id").orderBy("best_rank", "doc_id")
        got = got.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_size)
    return got.select(*KEY, "sources")


def sizes(universe: DataFrame) -> DataFrame:
    return universe.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_docs"))


def escapes(runs: DataFrame, universe: DataFrame, k_c: int) -> DataFrame:
    """Candidates outside the universe; there should be none."""
    return runs.where(F.col("rank") <= k_c).join(universe.select(*KEY), KEY, "left_anti").select("query_id", "doc_id", "system", "rank")


def require_contained(runs: DataFrame, universe: DataFrame, k_c: int) -> None:
    bad = escapes(runs, universe, k_c).limit(3).collect()
    if bad:
        raise UniverseError(f"candidates outside the universe, such as {[(r.query_id, r.doc_id) for r in bad]}")


def overlap(runs: DataFrame, first: str, second: str, k_c: int) -> DataFrame:
    """Per query: how two systems' candidate sets agree; the Jaccard of two empty sets is null."""
    top = runs.where((F.col("rank") <= k_c) & F.col("system").isin(first, second))
    docs = top.groupBy(*KEY).agg(F.max((F.col("system") == first).cast("int")).alias("a"), F.max((F.col("system") == second).cast("int")).alias("b"))
    got = docs.groupBy("query_id").agg(F.sum(F.col("a") * F.col("b")).alias("n_both"), F.sum(F.col("a") * (1 - F.col("b"))).alias("n_only_first"), F.sum(F.col("b") * (1 - F.col("a"))).alias("n_only_second"))
    return got.withColumn("jaccard", F.try_divide(F.col("n_both").cast("double"), F.col("n_both") + F.col("n_only_first") + F.col("n_only_second")))


def floored(run: DataFrame, system: str, universe: DataFrame) -> DataFrame:
    """A score for every universe document: absent ones get the query's least score less 1 (0 without any)."""
    own = run.where(F.col("system") == system).select(*KEY, "score")
    got = universe.select(*KEY).join(own, KEY, "left")
    least = F.min("score").over(Window.partitionBy("query_id"))
    return got.withColumn("retrieved", F.col("score").isNotNull()).withColumn("score", F.coalesce("score", least - 1, F.lit(0.0)))


def floor_counts(scored: DataFrame) -> DataFrame:
    got = scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_universe"), F.sum(F.col("retrieved").cast("long")).alias("n_retrieved"))
    return got.withColumn("n_floored", F.col("n_universe") - F.col("n_retrieved")).withColumn("floored_share", F.col("n_floored") / F.col("n_universe"))


def stage1_table(scored: DataFrame, system: str, checkpoint: str) -> DataFrame:
    """A run table over the whole universe, floored documents last."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.select(*KEY, F.lit(system).alias("system"), F.row_number().over(order).cast("long").alias("rank"), "score", F.lit(checkpoint).alias("checkpoint"))


def table_mismatches(table: DataFrame, run: DataFrame, universe: DataFrame, depths: list[int]) -> DataFrame:
    """Counts that should all be 0: top-k disagreements, documents missing or extra, floors out of order."""
    pairs = table.select("query_id", "rank", F.col("doc_id").alias("t")).join(run.select("query_id", "rank", F.col("doc_id").alias("r")), ["query_id", "rank"], "inner").where(F.col("rank") <= max(depths))
    wrong = pairs.agg(F.coalesce(F.sum((F.col("t") != F.col("r")).cast("long")), F.lit(0).cast("long")).alias("top_k_disagreements"))
    missing = universe.select(*KEY).join(table.select(*KEY), KEY, "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    extra = table.select(*KEY).join(universe.select(*KEY), KEY, "left_anti").agg(F.count(F.lit(1)).alias("extra"))
    known = run.select(*KEY).withColumn("known", F.lit(True))
    floor = table.join(known, KEY, "left").groupBy("query_id").agg(F.max(F.when(F.col("known").isNull(), F.col("score"))).alias("hi"), F.min(F.when(F.col("known"), F.col("score"))).alias("lo")).agg(F.coalesce(F.sum((F.col("hi") >= F.col("lo")).cast("long")), F.lit(0).cast("long")).alias("floors_out_of_order"))
    return wrong.join(F.broadcast(missing)).join(F.broadcast(extra)).join(F.broadcast(floor))  # one row each


def reference_subset(universe: DataFrame, size: int, seed: int = 42, n_strata: int = 5, key: DataFrame | None = None) -> list[str]:
    """Queries for full scoring: dealt in turn from equal bins by universe size, or by ``key(query_id, value)``.

    Within a bin queries follow the hash of their id with the seed. Taking one of each bin at a time
    is even over the bins, and a bin that runs out is made up for by the others.
    """
    by = (key or sizes(universe).withColumnRenamed("n_docs", "value")).select("query_id", F.col("value").cast("double").alias("value"))
    binned = by.withColumn("bin", F.ntile(n_strata).over(Window.orderBy("value", "query_id")))  # one row a query
    turn = F.row_number().over(Window.partitionBy("bin").orderBy(F.xxhash64(F.lit(seed), "query_id"), "query_id"))
    dealt = binned.withColumn("turn", turn).orderBy("turn", "bin").limit(size)
    return sorted(r.query_id for r in dealt.select("query_id").collect())
