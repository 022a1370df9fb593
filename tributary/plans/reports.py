"""Small reports: tables as CSV or Markdown, examples, scorer canaries."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import names as N
from ..errors import ListwiseScorerError, PassageError
from ..operators import effects

#: Fixed literal pairs that a scorer is tried on, to see whether it is still the same.
CANARY = [("what is a gate", f"A gate is passage number {i}." + " It lets few through." * i) for i in range(8)]


def save_table(df: DataFrame, path: str) -> None:
    """A report's rows as one CSV file with a header; for small tables."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_manifest(path: str, record: dict) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(record, f, indent=1, sort_keys=True, default=str)


def read_manifest(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def markdown(df: DataFrame, limit: int = 100) -> str:
    """The first rows of a small table as Markdown."""
    rows = df.limit(limit).collect()

    def cell(v) -> str:
        return "" if v is None else f"{v:.3g}" if isinstance(v, float) else str(v).replace("|", "\\|")

    return "\n".join([f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}", *(f"| {' | '.join(map(cell, r))} |" for r in rows)])


def clip(text, n: int = 230):
    """Text column cut to n characters with an ellipsis."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.substring(text, 1, n - 1)), F.lit("…"))).otherwise(text)


def gating_examples(stage: DataFrame, queries: DataFrame, passages: DataFrame, n: int = 5) -> DataFrame:
    """The n worst failures of different queries beside what the cascade put first; all texts have to be there."""
    worst = effects.worst_failures(stage, n).select("query_id", "doc_id", "rank_control", "effect")
    first = stage.where((F.col("effect_type") == N.E_RERANK) & (F.col("rank_treatment") == 1)).select("query_id", F.col("doc_id").alias("top_doc"))
    text = passages.select(F.col("doc_id"), F.col("text").alias("passage"))
    out = worst.join(queries.select("query_id", F.col("text").alias("query")), "query_id", "left").join(first, "query_id", "left").join(text, "doc_id", "left").join(text.withColumnsRenamed({"doc_id": "top_doc", "passage": "top_passage"}), "top_doc", "left")
    missing = out.where("passage is null or top_passage is null or query is null").limit(1).collect()
    if missing:
        raise PassageError(f"a text of query {missing[0]['query_id']} is missing")
    return out.withColumns({"passage": clip("passage"), "top_passage": clip("top_passage")}).orderBy("effect", "query_id")


def utility_by_share(intervals: DataFrame) -> DataFrame:
    """Mean change by share with its interval, and the anchor rows of t = 1."""
    anchor = intervals.select("policy").distinct().select("policy", F.lit(1.0).alias("t"), *[F.lit(0.0).alias(c) for c in ("point", "lo", "hi")])
    return intervals.select("policy", "t", "point", "lo", "hi").unionByName(anchor)


def off_diagonal(additive: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Share of documents that both stages move, and the largest residual."""
    both = (F.abs("e_gate") > tolerance) & (F.abs("e_rerank") > tolerance)
    return additive.agg(F.count(F.lit(1)).alias("n"), F.avg(both.cast("double")).alias("share_off_diagonal"), F.max(F.abs("residual")).alias("max_residual"))


Scorer = Callable[[pd.Series, pd.Series], pd.Series]


def scored(pairs: DataFrame, scorer: Scorer, batch: int = 64) -> DataFrame:
    """``pairs(query, text, ...)`` with a score by a pointwise scorer over Arrow batches."""
    if getattr(scorer, "listwise", False):
        raise ListwiseScorerError("a listwise score depends on the other documents")

    def run(batches):
        for pdf in batches:
            for s in range(0, len(pdf), batch):
                part = pdf.iloc[s : s + batch]
                got = scorer(part["query"], part["text"])
                if len(got) != len(part):
                    raise ValueError("a scorer returned another number of scores")
                yield part.assign(score=got.to_numpy(float))

    return pairs.mapInPandas(run, f"{pairs.schema.toDDL()}, score double")


def canary_digest(scorer: Scorer, places: int = 6) -> str:
    """Digest of a scorer's rounded canary scores."""
    q, t = (pd.Series(x) for x in zip(*CANARY, strict=True))
    return hashlib.sha256(json.dumps([round(float(s), places) for s in scorer(q, t)]).encode()).hexdigest()[:16]


def canaries_agree(a: list[float], b: list[float], tolerance: float = 1e-4) -> bool:
    """Same order and nearly the same scores: stores filled by both may be merged."""
    order = [sorted(range(len(x)), key=lambda i: (-x[i], i)) for x in (a, b)]
    return len(a) == len(b) and order[0] == order[1] and max((abs(x - y) for x, y in zip(a, b, strict=True)), default=0) <= tolerance


def score_digest(scores: DataFrame) -> str:
    """Digest of a score table that does not depend on its order or partitioning."""
    line = F.concat_ws("\t", "query_id", "doc_id", "model", F.col("score").cast("string"))
    word = F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    row = scores.agg(F.count(F.lit(1)).alias("n"), F.sum(word).alias("s")).first()
    return hashlib.sha256(f"{row['n']}:{row['s']}".encode()).hexdigest()[:16]

