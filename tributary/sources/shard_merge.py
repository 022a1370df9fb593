"""Merging stores that several owners filled into one, with every key accounted for.

All shards and the universe meet in one grouped pass over (query_id, doc_id): a pair is scored by one
owner, scored alike by several, scored differently (a conflict), not scored at all (a gap) or not asked
for (a stray). Nothing is settled silently: conflicts and gaps refuse the merge unless a rule is named.
Merged rows become visible by a manifest that is committed after they are written; the same inputs
give the same manifest and write nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConflictError, InputError, MissingScoreError
from .commits import CommitLog, content, mark_of
from .score_store import ScoreStore
from .tables import scratch

KEY = ["query_id", "doc_id"]
SINGLE, REPEATED, CONFLICT, GAP, STRAY = "single", "repeated", "conflict", "gap", "stray"
#: Rules for conflicts: the score of the owner named first, or of the latest version.
RULES = ("first", "latest")


def labelled(stores: dict[str, ScoreStore], model: str) -> DataFrame:
    """(owner, place, query_id, doc_id, score, version): each owner's latest scores of one model."""
    if not stores:
        raise InputError("no shard is given")
    parts = [s.versions(model).select(F.lit(owner).alias("owner"), F.lit(i).alias("place"), *KEY, "score", "version") for i, (owner, s) in enumerate(stores.items())]
    return reduce(DataFrame.unionByName, parts)


def reconcile(shards: DataFrame, universe: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """One row per pair that any side has: query_id, doc_id, status, owners, lowest, highest, first, latest.

    Owners come in the order of their names; scores that differ by no more than ``tolerance`` agree.
    Repeated universe rows count once. A pair that is not asked for is a stray, whoever scored it.
    """
    nothing = {"owner": "string", "place": "int", "score": "double", "version": "long"}
    asked = universe.select(*KEY, *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()], F.lit(True).alias("asked"))
    both = shards.select(*KEY, *nothing, F.lit(False).alias("asked")).unionByName(asked)
    met = both.groupBy(*KEY).agg(
        F.array_sort(F.collect_set("owner")).alias("owners"), F.min("score").alias("lowest"), F.max("score").alias("highest"),
        F.min_by("score", "place").alias("first"), F.max_by("score", F.struct("version", -F.col("place"))).alias("latest"), F.bool_or("asked").alias("asked"),
    )
    n = F.size("owners")
    status = F.when(~F.col("asked"), STRAY).when(n == 0, GAP).when(F.col("highest") - F.col("lowest") > tolerance, CONFLICT).when(n > 1, REPEATED).otherwise(SINGLE)
    return met.select(*KEY, status.alias("status"), "owners", "lowest", "highest", "first", "latest")


def by_owner(pairs: DataFrame) -> DataFrame:
    """(owner, single, repeated, conflict, stray): what each shard holds of :func:`reconcile`."""
    each = pairs.where(F.size("owners") > 0).select(F.explode("owners").alias("owner"), "status")
    return each.groupBy("owner").agg(*[F.sum((F.col("status") == s).cast("long")).alias(s) for s in (SINGLE, REPEATED, CONFLICT, STRAY)])


def by_query(pairs: DataFrame) -> DataFrame:
    """(query_id, asked, held, gap, conflict) of the queries of the universe."""
    counts = [F.sum((F.col("status") == s).cast("long")).alias(s) for s in (GAP, CONFLICT)]
    got = pairs.where(F.col("status") != STRAY).groupBy("query_id").agg(F.count(F.lit(1)).alias("asked"), *counts)
    return got.select("query_id", "asked", (F.col("asked") - F.col(GAP)).alias("held"), GAP, CONFLICT)


def merge(spark: SparkSession, path: str, stores: dict[str, ScoreStore], model: str, universe: DataFrame, *, on_conflict: str | None = None, allow_gaps: bool = False, tolerance: float = 0.0, **extra) -> dict:
    """Merge the stores below ``path`` and give the manifest that was committed.

    The manifest has each owner's counts and content digest, the pairs asked for, merged and missing, the
    conflicts and by which rule they were settled, whether the universe is complete, and what ``extra``
    adds. A merge of the same contents finds its manifest and writes nothing.
    """
    if on_conflict is not None and on_conflict not in RULES:
        raise InputError(f"a conflict is settled by one of {', '.join(RULES)}")
    log = CommitLog(spark, f"{path}/manifests")
    digests = {o: content(s.versions(model), *KEY, "score", "version").first().asDict() for o, s in stores.items()}
    asked = content(universe.select(*KEY).distinct(), *KEY).first().asDict()
    mark = mark_of(model=model, shards=digests, order=list(stores), universe=asked, rule=on_conflict, gaps=allow_gaps, tolerance=tolerance, extra=extra)
    if (held := log.done().get(model)) and held["mark"] == mark:
        return held
    place = scratch(spark, "reconciled")
    reconcile(labelled(stores, model), universe, tolerance).write.parquet(place)
    pairs = spark.read.parquet(place)
    n = {r.status: r["count"] for r in pairs.groupBy("status").count().collect()}
    if n.get(CONFLICT) and on_conflict is None:
        worst = pairs.where(F.col("status") == CONFLICT).orderBy(F.desc(F.col("highest") - F.col("lowest")), *KEY).limit(3).collect()
        raise ConflictError(f"{n[CONFLICT]} pairs have scores that differ: {[(r.query_id, r.doc_id, r.owners, r.lowest, r.highest) for r in worst]}")
    if n.get(GAP) and not allow_gaps:
        worst = by_query(pairs).where(F.col(GAP) > 0).orderBy(F.desc(GAP), "query_id").limit(3).collect()
        raise MissingScoreError(f"{n[GAP]} pairs have no score of {model}: {[(r.query_id, r[GAP]) for r in worst]}")
    score = F.col("latest") if on_conflict == "latest" else F.col("first")
    merged = pairs.where(~F.col("status").isin(GAP, STRAY)).select(*KEY, score.alias("score"), F.lit(model).alias("model"))
    merged.write.mode("overwrite").parquet(f"{path}/rows/{mark}")
    owners = {r.owner: {**digests[r.owner], **{s: r[s] for s in (SINGLE, REPEATED, CONFLICT, STRAY)}} for r in by_owner(pairs).collect()}
    missing = n.get(GAP, 0)
    manifest = {"mark": mark, "model": model, "owners": owners, "asked": asked["rows"], "merged": asked["rows"] - missing, "missing": missing, "conflicts": n.get(CONFLICT, 0), "rule": on_conflict, "strays": n.get(STRAY, 0), "complete": not missing, **extra}
    log.commit({model: manifest})
    return manifest


def merged_scores(spark: SparkSession, path: str, model: str) -> DataFrame:
    """(query_id, doc_id, score, model) of the last committed merge; without one it is refused."""
    manifest = CommitLog(spark, f"{path}/manifests").done().get(model)
    if manifest is None:
        raise InputError(f"no merge of {model} has been committed at {path}")
    return spark.read.parquet(f"{path}/rows/{manifest['mark']}")
