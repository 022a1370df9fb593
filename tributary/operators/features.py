"""Features known before any extra scoring, and cheap predictors built on them.

Only candidates have their s2 read: what a cascade has not scored must not leak into a feature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import names as N
from ..errors import InputError
from .ranking import heads

SHARED = ["s1_log_rank", "s1_margin", "s1_floored", "alt_log_rank", "alt_top_kc", "alt_floored"]
SURVIVOR = [*SHARED, "s2_score", "s2_rank", "s2_margin_k", "displacement"]


def wide(worlds: DataFrame, k: int, depth: int) -> DataFrame:
    """One row per (query, document, k_c) with all features; s2 features are null outside the gate.

    The scores at the cuts are those of single candidates: they are found among candidates and joined to the
    rows, so no task holds a query for them.
    """
    q = ["query_id", "k_c", "condensed"]
    inside = F.col("in_cq")
    alt = F.coalesce(F.col("alt_rank"), F.col("n_docs") + 1).cast("double")
    at_s1, at_s2 = F.col("rank_s1") == F.col("k_c"), F.col("rank_a") == F.least(F.lit(k), F.col("k_c"))
    cuts = worlds.where(inside & (at_s1 | at_s2)).groupBy(*q).agg(F.max(F.when(at_s1, F.col("s1"))).alias("_s1_cut"), F.max(F.when(at_s2, F.col("s2"))).alias("_s2_cut"))
    s1_cut, s2_cut = F.col("_s1_cut"), F.col("_s2_cut")
    return worlds.join(heads(cuts, "cuts"), q, "left").select(
        "query_id", "doc_id", "k_c", inside.alias("survivor"),
        F.log(F.col("rank_s1").cast("double")).alias("s1_log_rank"), (F.col("s1") - s1_cut).alias("s1_margin"), (F.col("rank_s1") > depth).cast("double").alias("s1_floored"),
        F.log(alt).alias("alt_log_rank"), (alt <= F.col("k_c")).cast("double").alias("alt_top_kc"), (alt > depth).cast("double").alias("alt_floored"),
        F.when(inside, F.col("s2")).alias("s2_score"), F.col("rank_a").cast("double").alias("s2_rank"), F.when(inside, F.col("s2") - s2_cut).alias("s2_margin_k"), (F.col("rank_s1") - F.col("rank_a")).cast("double").alias("displacement"),
    )


def long(features: DataFrame, version: str = "v1") -> DataFrame:
    """The feature table: one row per feature that a document has."""
    out = features.unpivot(["query_id", "doc_id"], SURVIVOR, "feature_name", "value").where("value is not null")
    return out.select("query_id", "doc_id", F.lit(version).alias("feature_version"), "feature_name", "value", F.lit(0.0).alias("generation_seconds"))


def pivot(table: DataFrame) -> DataFrame:
    """Back to one row per document; the names are given, so no extra pass looks for them."""
    return table.groupBy("query_id", "doc_id").pivot("feature_name", SURVIVOR).agg(F.first("value"))


def stage1_positions(ranked: DataFrame, k_c: int) -> DataFrame:
    """Rank share within the gate (1 beyond it), percentile in the query and membership."""
    n = F.col("n_docs")
    return ranked.select(
        "query_id", "doc_id", F.least(F.lit(1.0), (F.col("rank_s1") - 1) / F.lit(float(max(k_c - 1, 1)))).alias("rank_share"),
        (1 - (F.col("rank_s1") - 1) / F.greatest(n - 1, F.lit(1))).alias("percentile"), (F.col("rank_s1") <= k_c).alias("survivor"),
    )


def stage2_norms(worlds: DataFrame) -> DataFrame:
    """Candidates' s2, scaled to 0..1 within the query's candidates."""
    q = Window.partitionBy("query_id", "k_c", "condensed")
    lo, hi = F.min("s2").over(q), F.max("s2").over(q)
    return worlds.where("in_cq").select("query_id", "doc_id", "k_c", "s2", ((F.col("s2") - lo) / F.greatest(hi - lo, F.lit(1e-12))).alias("s2_norm"))


def passage_lengths(passages: DataFrame) -> DataFrame:
    """(query_id, doc_id, words, words by the query's mean) of ``passages(query_id, doc_id, text)``."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    got = passages.select("query_id", "doc_id", words.alias("words"))
    return got.withColumn("relative_words", F.try_divide(F.col("words").cast("double"), F.avg("words").over(Window.partitionBy("query_id"))))


def attach(effects: DataFrame, features: DataFrame) -> DataFrame:
    """Effects with their features; a document without features is refused."""
    key = ["query_id", "doc_id", "k_c"]
    out = effects.join(features.withColumn("_known", F.lit(True)), key, "left")
    return out.where(F.when(F.col("_known"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no features for document "), "doc_id")).cast("boolean"))).drop("_known")


def membership(effects: DataFrame) -> DataFrame:
    """Constant predictors: zero, and +1 / -1 by survival (null for other strata)."""
    sign = F.when(F.col("stratum") == N.SURVIVOR, 1.0).when(F.col("stratum") == N.NON_SURVIVOR, -1.0)
    return effects.withColumns({"pred_zero": F.lit(0.0), "pred_membership": sign})


def stratum_means(train: DataFrame, effects: DataFrame) -> DataFrame:
    """Training mean of each (effect type, stratum) as a predictor; structural zeros are 0, unseen ones the overall mean."""
    zero = F.coalesce(*[F.when(F.col("effect_type") == k, F.col("stratum").isin(*v) if v else F.lit(False)) for k, v in N.STRUCTURAL_ZERO.items()], F.lit(False))
    means = train.groupBy("effect_type", "stratum").agg(F.avg("effect").alias("_mean"))
    overall = train.groupBy("effect_type").agg(F.avg("effect").alias("_all"))
    out = effects.join(F.broadcast(means), ["effect_type", "stratum"], "left").join(F.broadcast(overall), "effect_type", "left")
    return out.withColumn("pred_stratum_mean", F.when(zero, 0.0).otherwise(F.coalesce("_mean", "_all"))).drop("_mean", "_all")


def fit_predict(train: DataFrame, test: DataFrame, columns: list[str], kind: str = "ridge", alpha: float = 1.0, seed: int = 42) -> DataFrame:
    """``test`` with a prediction of ``effect`` from ``columns`` by ridge, forest or boosted trees.

    Features are standardised on the training rows. Rows with a missing feature get no prediction;
    fewer than 20 training rows or a constant target give the training mean.
    """
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    whole = " and ".join(f"{c} is not null and not isnan({c})" for c in columns)
    known = train.where(whole).where("effect is not null")
    facts = known.agg(F.count(F.lit(1)).alias("n"), F.avg("effect").alias("mean"), F.stddev_pop("effect").alias("sd")).first()
    if facts["n"] < 20 or not facts["sd"]:
        return test.withColumn("prediction", F.when(F.expr(whole), F.lit(facts["mean"] or 0.0)))
    assembler = VectorAssembler(inputCols=columns, outputCol="_raw")
    packed = assembler.transform(known)
    scaler = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True).fit(packed)
    if kind == "ridge":  # the regularisation that makes this (X'X + alpha I) w = X'y
        n = facts["n"]
        model = LinearRegression(featuresCol="_x", labelCol="effect", regParam=alpha * facts["sd"] / n, elasticNetParam=0.0, standardization=False, solver="normal")
    elif kind == "forest":
        model = RandomForestRegressor(featuresCol="_x", labelCol="effect", seed=seed, numTrees=50)
    elif kind == "boosted":
        model = GBTRegressor(featuresCol="_x", labelCol="effect", seed=seed, maxIter=50, stepSize=0.05, maxDepth=3, minInstancesPerNode=20)
    else:
        raise InputError(f"unknown model {kind!r}")
    fitted = model.fit(scaler.transform(packed))
    ready = VectorAssembler(inputCols=columns, outputCol="_raw", handleInvalid="skip").transform(test.where(whole))
    out = fitted.transform(scaler.transform(ready)).drop("_raw", "_x")
    return out.unionByName(test.where(f"not ({whole})").withColumn("prediction", F.lit(None).cast("double")))


# Ridge for many groups at once: sums of products in one aggregate, a small system of equations per group


def _whole(columns: list[str]):
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return out


def gram(train: DataFrame, keys: list[str], columns: list[str], target: str = "effect") -> DataFrame:
    """(keys, n, y, x, xy, xx): sums over complete rows; xx has the products of columns i <= j in order.

    The sums are additive, so Spark combines them before the shuffle and a group leaves one row a task.
    """
    rows = train.where(_whole([*columns, target])).select(*keys, F.col(target).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    x = [F.col(f"_x{i}") for i in range(len(columns))]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("y"), F.array(*map(F.sum, x)).alias("x"),
        F.array(*[F.sum(a * F.col("_y")) for a in x]).alias("xy"), F.array(*[F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))]).alias("xx"),
    )


def solve(sums: DataFrame, keys: list[str], columns: list[str], alpha: float = 1.0, least: int = 20) -> DataFrame:
    """(keys, n, intercept, weights) of each row of :func:`gram`.

    (Z'Z + alpha I) w = Z'y on features scaled to mean 0 and variance 1 over the group; weights are given
    for the unscaled ones. A constant feature has weight 0, and fewer than ``least`` rows give their mean.
    """
    d = len(columns)
    upper = np.triu_indices(d)
    kinds = {f.name: f.dataType.simpleString() for f in sums.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                n, mean = r.n, np.asarray(r.x, float) / r.n
                weights, y = np.zeros(d), r.y / r.n
                if n >= least:
                    second = np.zeros((d, d))
                    second[upper] = np.asarray(r.xx, float)
                    second = (second + np.triu(second, 1).T) / n
                    cov, cross = second - np.outer(mean, mean), np.asarray(r.xy, float) / n - mean * y
                    varied = np.flatnonzero(np.diag(cov) > 1e-12 * (1 + np.diag(second)))
                    scale = np.sqrt(np.diag(cov)[varied])
                    z = n * cov[np.ix_(varied, varied)] / np.outer(scale, scale)
                    weights[varied] = np.linalg.solve(z + alpha * np.eye(len(varied)), n * cross[varied] / scale) / scale
                rows.append((*(getattr(r, k) for k in keys), n, float(y - weights @ mean), weights))
            yield pd.DataFrame(rows, columns=[*keys, "n", "intercept", "weights"])

    return sums.mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "n long, intercept double, weights array<double>"]))


def predict(test: DataFrame, models: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``test`` with a prediction; rows that lack a feature or whose group has no model get none."""
    each = F.lit(0.0)
    for i, c in enumerate(columns):
        each = each + F.get("weights", F.lit(i)) * F.col(c).cast("double")
    held = F.broadcast(models.select(*keys, "intercept", "weights"))  # a row per group of the settings
    return test.join(held, keys, "left").withColumn("prediction", F.when(_whole(columns), F.col("intercept") + each)).drop("intercept", "weights")
