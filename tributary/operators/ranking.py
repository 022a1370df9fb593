"""Total orders, ranks and top-k per query.

The order is by score, highest first, then doc_id; a missing score is refused rather than sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import scratch


def scored(column: str) -> Column:
    """The column, or an error where it is null or NaN."""
    bad = F.col(column).isNull() | F.isnan(F.col(column).cast("double"))
    return F.when(bad, F.raise_error(F.concat(F.lit(f"{column} is missing for document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).cast("double")).otherwise(F.col(column))


def tasks(df: DataFrame) -> int:
    """The session's number of shuffle partitions. Adaptive execution joins partitions by their size before
    rows are multiplied by depths, cells and utilities; a number that is given stays."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a table of heads that is broadcast.
FEW = 100_000


def heads(df: DataFrame, name: str) -> DataFrame:
    """A table of the first documents of queries, written once, and marked for broadcast if it has at most FEW
    rows; with more a join with it shuffles."""
    place = scratch(df.sparkSession, name)
    df.write.parquet(place)
    held = df.sparkSession.read.schema(df.schema).parquet(place)
    return F.broadcast(held) if held.count() <= FEW else held


def by_score(score: Column | str, *keys: str) -> Window:
    return Window.partitionBy("query_id", *keys).orderBy(F.desc(score), F.asc("doc_id"))


def rank_by(df: DataFrame, score: str, name: str = "rank", *keys: str) -> DataFrame:
    """``df`` with the 1-based rank of each document by ``score`` within query (and ``keys``)."""
    return df.withColumn(score, scored(score)).withColumn(name, F.row_number().over(by_score(score, *keys)))


def top_k(df: DataFrame, score: str, k: int, name: str = "rank") -> DataFrame:
    """The first k documents of each query; the planner limits groups before the shuffle."""
    return rank_by(df, score, name).where(F.col(name) <= k)


def run_table(scores: DataFrame, system: str, checkpoint: str, depth: int | None = None) -> DataFrame:
    """A ``run`` table from (query_id, doc_id, score)."""
    out = rank_by(scores, "score")
    out = out if depth is None else out.where(F.col("rank") <= depth)
    return out.select("query_id", "doc_id", F.lit(system).alias("system"), F.col("rank").cast("long").alias("rank"), F.col("score").cast("double").alias("score"), F.lit(checkpoint).alias("checkpoint"))


def condense(ranked: DataFrame, rank: str = "rank") -> DataFrame:
    """Judged documents only, ranks recounted in the order they had."""
    order = Window.partitionBy("query_id").orderBy(rank)
    return ranked.where(F.coalesce("judged", F.lit(False))).withColumn(rank, F.row_number().over(order))


def rank_in_ranges(df: DataFrame, score: str, name: str = "rank", ranges: int = 200, marked: str | None = None, total: str | None = None) -> DataFrame:
    """The ranks of :func:`rank_by` where single queries are too large for one task.

    Rows are dealt out by ranges of (query, score, doc_id), so a hot query spans many tasks; each
    range ranks its own rows and adds the number of the query's rows in earlier ranges. Ranges are
    written first, since the counts and the ranks have to see the same ones. With ``marked``, a boolean
    column, ``<name>_marked`` counts the marked rows up to each; ``total`` names the query's number of rows.
    """
    spark = df.sparkSession
    dealt = df.withColumn(score, scored(score)).repartitionByRange(ranges, "query_id", F.desc(score), "doc_id")
    place = scratch(spark, "ranges")
    dealt.withColumn("_range", F.spark_partition_id()).write.parquet(place)
    dealt = spark.read.parquet(place)
    mark = F.coalesce(F.col(marked), F.lit(False)).cast("long") if marked else F.lit(0).cast("long")
    counts = dealt.groupBy("query_id", "_range").agg(F.count(F.lit(1)).alias("_n"), F.sum(mark).alias("_m"))
    query = Window.partitionBy("query_id")
    earlier = query.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("query_id", "_range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_m")], F.sum("_n").over(query).alias("_total"))
    own = by_score(score, "_range")
    more = {name: F.row_number().over(own) + F.col("_n_before")}
    if marked:
        more[f"{name}_marked"] = F.sum(mark).over(own.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_m_before")
    if total:
        more[total] = F.col("_total")
    return dealt.join(before, ["query_id", "_range"]).withColumns(more).drop("_range", "_n_before", "_m_before", "_total")


#: Rows of one query that a task ranks by a window, and rows of a range of larger ones.
LARGE, RANGE_ROWS = 4_000_000, 1_000_000


def ranges_for(df: DataFrame) -> int | None:
    """The ranges that :func:`rank_in_ranges` should deal ``df`` into, or None where each query fits in a task."""
    sizes = df.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("largest"), F.sum("n").alias("rows")).first()
    return None if (sizes.largest or 0) <= LARGE else -(-sizes.rows // RANGE_ROWS)
