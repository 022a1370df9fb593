"""Cascades derived from the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import table


def event_cascade(spark: SparkSession, folder: str, swapped: bool = False, whole: bool = False) -> DataFrame:
    """Twenty queries over ``events``; ``swapped`` lets the other retriever be the first stage.

    doc_id holds seven digits of the event's id, as in the SQL, and repeats beyond ten million events. ``whole`` ids
    hold all digits: for tables whose keys may not repeat. They sort as the short ones do, which :func:`short` gives.
    """
    e = table(spark, folder, "events")
    digits = F.col("event_id").cast("string")
    own, other = F.col("value").cast("double"), ((F.col("event_id") * 104729) % 10009).cast("double")
    s1, alt = (other, own) if swapped else (own, other)
    grade = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    judged = F.col("event_id") % 3 != 0
    rows = e.select(
        F.concat(F.lit("q"), F.lpad((F.col("user_id") % 20).cast("string"), 2, "0")).alias("query_id"),
        F.concat(F.lit("d"), F.lpad(digits, F.greatest(F.length(digits), F.lit(7)) if whole else 7, "0")).alias("doc_id"),
        s1.alias("s1"),
        (((F.col("event_id") * 7919) % 10007).cast("double") / F.lit(10007.0)).alias("s2"),
        alt.alias("alt_score"),
        F.when(judged, grade).cast("long").alias("relevance"),
        judged.alias("judged"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("alt_score"), "doc_id")
    return rows.withColumn("alt_rank", F.row_number().over(order)).select("query_id", "doc_id", "s1", "s2", "alt_rank", "relevance", "judged", "alt_score")


def short(df: DataFrame) -> DataFrame:
    """Rows with whole ids by the seven digits that the SQL shows of them."""
    return df.withColumn("doc_id", F.substring("doc_id", 1, 8))


def event_runs(spark: SparkSession, folder: str, depth: int, whole: bool = False) -> DataFrame:
    """Two retrievers' runs over the event cascade, cut at ``depth``."""
    c = event_cascade(spark, folder, whole=whole)

    def run(score: str, system: str) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc(score), "doc_id")
        return c.select("query_id", "doc_id", F.lit(system).alias("system"), F.row_number().over(order).cast("long").alias("rank"), F.col(score).alias("score"), F.lit("v1").alias("checkpoint")).where(F.col("rank") <= depth)

    return run("s1", "value").unionByName(run("alt_score", "mix"))


def event_qrels(spark: SparkSession, folder: str, whole: bool = False) -> DataFrame:
    return event_cascade(spark, folder, whole=whole).where("judged").select("query_id", "doc_id", "relevance", "judged")
