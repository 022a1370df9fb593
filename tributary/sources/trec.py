"""Text sources: judgments, queries and passages, each refused where it is malformed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError, PassageError


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """``qid iter doc grade`` lines; blank ones are skipped, other arities and grades that are no numbers refused."""
    line = F.trim("value")
    parts = F.split(line, r"\s+")
    rows = spark.read.text(path).where(line != "").select(parts.alias("p"), "value")
    bad = rows.where((F.size("p") != 4) | F.get("p", F.lit(3)).try_cast("long").isNull()).limit(1).collect()
    if bad:
        raise InputError(f"{path}: not a judgment: {bad[0]['value']!r}")
    return rows.select(F.get("p", F.lit(0)).alias("query_id"), F.get("p", F.lit(2)).alias("doc_id"), F.get("p", F.lit(3)).cast("long").alias("relevance"), F.lit(True).alias("judged"))


def read_queries(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``qid<TAB>text`` lines; with ``strict`` a missing tab, an empty text or a repeated id is refused."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.split("value", "\t", 2).alias("p"), "value")
    out = rows.select(F.trim(F.get("p", F.lit(0))).alias("query_id"), F.trim(F.get("p", F.lit(1))).alias("text"))
    if strict:
        bad = rows.where((F.size("p") != 2) | (F.trim(F.get("p", F.lit(1))) == "")).limit(1).collect()
        if bad:
            raise InputError(f"{path}: not a query: {bad[0]['value']!r}")
        twice = out.groupBy("query_id").count().where("count > 1").limit(1).collect()
        if twice:
            raise InputError(f"{path}: query {twice[0]['query_id']} is there twice")
    return out.where("text is not null")


def passages(corpus: DataFrame, required: DataFrame) -> DataFrame:
    """Texts of the required doc_ids; a missing one is refused."""
    ids = required.select("doc_id").distinct()
    missing = ids.join(corpus.select("doc_id"), "doc_id", "left_anti").limit(3).collect()
    if missing:
        raise PassageError(f"no text for {[r.doc_id for r in missing]}")
    return corpus.join(ids, "doc_id", "left_semi")


def judged_queries(queries: DataFrame, qrels: DataFrame, expected: int | None = None) -> DataFrame:
    """Queries that have judgments; their number is checked where it is known."""
    out = queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi")
    if expected is not None and (n := out.count()) != expected:
        raise InputError(f"{n} judged queries, not {expected}")
    return out
