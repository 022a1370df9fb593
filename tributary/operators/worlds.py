"""Worlds A, B and C of a two-stage cascade as rank columns on one frame.

A cascade has a row per (query_id, doc_id) with s1, s2, alt_rank (the other retriever's rank, may be
null), relevance and judged. The candidates of a query are its K_c best by s1.

* world A: candidates in s2 order (the cascade as it is)
* world B: candidates in s1 order (no reranker)
* world C: all documents in s2 order (no gate)

Both orders are ranked once and written; read again, each query's documents are dealt out over all tasks, depths and
modes multiply the rows only afterwards, and nothing gathers a query again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InputError
from ..sources.tables import scratch
from .ranking import by_score, heads, rank_in_ranges, scored, tasks

COLUMNS = ["query_id", "doc_id", "s1", "s2", "alt_rank", "relevance", "judged"]


def ranked(cascade: DataFrame, ranges: int | None = None) -> DataFrame:
    """The cascade with rank_s1, rank_s2, the same ranks counted among judged documents, and n_docs of its query.

    A query is a task of windows; with ``ranges`` (see :func:`ranking.ranges_for`) its documents are dealt
    out by ranges of either score instead.
    """
    own = cascade.select(*COLUMNS).withColumns({"s1": scored("s1"), "s2": scored("s2"), "judged": F.coalesce("judged", F.lit(False))})
    if ranges:
        first = rank_in_ranges(own, "s1", "rank_s1", ranges, marked="judged", total="n_docs")
        both = rank_in_ranges(first, "s2", "rank_s2", ranges, marked="judged")
        return both.select(*COLUMNS, "rank_s1", "rank_s2", F.col("rank_s1_marked").alias("judged_s1"), F.col("rank_s2_marked").alias("judged_s2"), "n_docs")
    own = own.repartition(tasks(cascade), "query_id")

    def judged(score: str) -> Column:
        return F.sum(F.col("judged").cast("int")).over(by_score(score).rowsBetween(Window.unboundedPreceding, 0)).cast("int")

    return own.select(
        "*",
        F.row_number().over(by_score("s1")).alias("rank_s1"),
        F.row_number().over(by_score("s2")).alias("rank_s2"),
        judged("s1").alias("judged_s1"),
        judged("s2").alias("judged_s2"),
        F.count(F.lit(1)).over(Window.partitionBy("query_id")).alias("n_docs"),
    )


def kept(cascade: DataFrame, ranges: int | None = None) -> DataFrame:
    """:func:`ranked`, worked out and written once. What reads it has each query's documents dealt out over all
    tasks, so that whatever multiplies them holds parts of queries only."""
    place = scratch(cascade.sparkSession, "ranked")
    ranked(cascade, ranges).write.parquet(place)
    return cascade.sparkSession.read.parquet(place).repartition(tasks(cascade), "query_id", "rank_s1")


def build_worlds(cascade: DataFrame, depths: Sequence[int], modes: Sequence[bool] = (False,), ranges: int | None = None) -> DataFrame:
    """Rows (query, document, k_c, condensed) with rank_a, rank_b and rank_c (null: absent).

    The condensed mode keeps judged documents and recounts their ranks; candidates stay the same.
    A depth that leaves no document outside the gate is refused.
    """
    return from_ranked(kept(cascade, ranges), depths, modes)


def from_ranked(rows: DataFrame, depths: Sequence[int], modes: Sequence[bool] = (False,)) -> DataFrame:
    """:func:`build_worlds` on what :func:`kept` gave, for those who keep it.

    Candidates are the head of the s1 order, so ranks in B and C are those in all of the query, among
    judged documents in the condensed mode. Only candidates are sorted again, for A, apart from the rest; their
    ranks are joined to the rows before depths and modes multiply these.
    """
    if not depths or min(depths) < 1:
        raise InputError("candidate depths have to be positive")
    inside, condensed = F.col("rank_s1") <= F.col("k_c"), F.col("condensed")
    cell = F.col("k_c") * 2 + condensed.cast("int")

    def multiplied(df: DataFrame) -> DataFrame:
        each = df.withColumn("k_c", F.explode(F.array(*map(F.lit, depths)))).withColumn("condensed", F.explode(F.array(*map(F.lit, modes))))
        return each.where(~condensed | F.col("judged"))

    own = multiplied(rows.where(F.col("rank_s1") <= max(depths)).select("query_id", "rank_s1", "rank_s2", "judged")).where(inside)
    own = own.withColumn("rank_a", F.row_number().over(Window.partitionBy("query_id", "k_c", "condensed").orderBy("rank_s2")))
    first = heads(own.groupBy("query_id", "rank_s1").agg(F.map_from_entries(F.collect_list(F.struct(cell, "rank_a"))).alias("_a")), "candidates")
    base = rows.join(first, ["query_id", "rank_s1"], "left").select(*rows.columns, "_a")
    base = multiplied(base).where(F.when(F.col("k_c") < F.col("n_docs"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no document lies outside the gate of query "), "query_id")).cast("boolean")))
    return base.withColumns(
        {
            "in_cq": inside,
            "rank_a": F.when(inside, F.try_element_at("_a", cell)),
            "rank_b": F.when(inside, F.when(condensed, F.col("judged_s1")).otherwise(F.col("rank_s1"))),
            "rank_c": F.when(condensed, F.col("judged_s2")).otherwise(F.col("rank_s2")),
        }
    ).drop("_a", "judged_s1", "judged_s2")


def isolation_violations(worlds: DataFrame) -> DataFrame:
    """Per (query, k_c, condensed): ways in which A, B and C fail to hold the documents they should."""
    return (
        worlds.groupBy("query_id", "k_c", "condensed")
        .agg(
            F.sum((F.col("rank_a").isNotNull() != F.col("rank_b").isNotNull()).cast("int")).alias("a_not_b"),
            F.sum((F.col("rank_a").isNotNull() & F.col("rank_c").isNull()).cast("int")).alias("a_not_c"),
            (F.count("rank_c") - F.countDistinct("rank_c")).alias("repeated_c"),
            (F.count("rank_a") - F.countDistinct("rank_a")).alias("repeated_a"),
        )
        .where("a_not_b + a_not_c + repeated_c + repeated_a > 0")
    )


def baseline_agreement(allocated: DataFrame) -> DataFrame:
    """Per run at t = 1: whether its world is the one that the design intends.

    Where the budget is K_c it has to be the cascade as it is: it submits exactly the candidates
    (``wrong_members`` counts those it does not) and ranks them as world A (``wrong_ranks``). With another
    budget it has to submit as many documents as are paid for, or all there are (``unspent``).
    """
    base = allocated.where("t = 1.0")
    own = F.col("submitted")
    same = F.col("budget") == F.col("k_c")
    counts = base.groupBy("query_id", "k_c", "condensed", "policy", "seed").agg(
        F.max("budget").alias("budget"),
        F.sum((same & (own != F.col("in_cq"))).cast("long")).alias("wrong_members"),
        F.sum((same & own & ~F.col("rank_t").eqNullSafe(F.col("rank_a"))).cast("long")).alias("wrong_ranks"),
        (F.least(F.max("budget"), F.max("k_c"), F.count(F.lit(1))) - F.sum(own.cast("long"))).alias("unspent"),
    )
    return counts.withColumn("agrees", (F.col("wrong_members") == 0) & (F.col("wrong_ranks") == 0) & (F.col("unspent") == 0))
