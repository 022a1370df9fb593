"""Table contracts: fixed schemas, keys and row rules, checked in one pass per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import names as N
from .errors import ContractError

# The columns and keys of the tables.
SCHEMAS = {
    "run": "query_id string, doc_id string, system string, rank long, score double, checkpoint string",
    "universe": "query_id string, doc_id string, sources string",
    "qrels": "query_id string, doc_id string, relevance long, judged boolean",
    "stage2_cache": "query_id string, doc_id string, model string, score double",
    "effect": "query_id string, doc_id string, stage1_system string, effect_type string, k_c long, k long, utility string, condensed boolean, budget_b long, t double, policy string, seed long, stratum string, judged boolean, rank_treatment long, rank_control long, utility_treatment double, utility_control double, effect double",
    "feature": "query_id string, doc_id string, feature_version string, feature_name string, value double, generation_seconds double",
}
KEYS = {
    "run": ["query_id", "doc_id", "system"],
    "universe": ["query_id", "doc_id"],
    "qrels": ["query_id", "doc_id"],
    "stage2_cache": ["query_id", "doc_id", "model"],
    "effect": ["query_id", "doc_id", "stage1_system", "effect_type", "k_c", "k", "utility", "condensed", "budget_b", "t", "policy", "seed"],
    "feature": ["query_id", "doc_id", "feature_name", "feature_version"],
}
NULLABLE_KEYS = {"budget_b", "t", "policy", "seed"}


def schema(kind: str) -> T.StructType:
    if kind not in SCHEMAS:
        raise ContractError(f"unknown table kind {kind!r}, expected one of {sorted(SCHEMAS)}")
    return T._parse_datatype_string(SCHEMAS[kind])


def empty(spark: SparkSession, kind: str) -> DataFrame:
    return spark.createDataFrame([], schema(kind))


def coerce(df: DataFrame, kind: str) -> DataFrame:
    """Declared columns in order and type, undeclared ones dropped; a value that cannot be cast is an error."""
    fields = schema(kind).fields
    missing = [f.name for f in fields if f.name not in df.columns]
    if missing:
        raise ContractError(f"{kind}: missing columns {missing}")

    def cast(f: T.StructField):
        to = F.col(f.name).try_cast(f.dataType)
        lost = F.col(f.name).isNotNull() & to.isNull()
        return F.when(lost, F.raise_error(F.lit(f"{kind}: {f.name} does not fit {f.dataType.simpleString()}")).cast(f.dataType)).otherwise(to).alias(f.name)

    return df.select(*map(cast, fields))


def _rules(kind: str) -> dict:
    c = F.col
    if kind == "run":
        return {"rank below 1": c("rank").isNull() | (c("rank") < 1), "score missing": c("score").isNull() | F.isnan("score")}
    if kind == "universe":
        return {"no sources": F.coalesce(c("sources"), F.lit("")) == ""}
    if kind == "qrels":
        judged = F.coalesce(c("judged"), F.lit(False))
        return {"judged without grade": judged & c("relevance").isNull(), "grade without judgment": ~judged & c("relevance").isNotNull()}
    if kind == "stage2_cache":
        return {"score missing": c("score").isNull() | F.isnan("score")}
    if kind == "effect":
        known = F.coalesce(*[F.when(c("effect_type") == k, c("stratum").isin(*v)) for k, v in N.STRATA.items()], F.lit(False))
        return {"unknown stratum": ~known, "definition": F.abs(c("effect") - (c("utility_treatment") - c("utility_control"))) > N.EPS}
    return {}


#: Rows that a task of the check for repeated keys holds.
KEY_ROWS = 500_000


def repeated(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """(keys, count) of keys that several of the ``rows`` rows have. Nearly all keys differ, so adding up before
    rows are moved would hold each task's keys and save nothing: they are dealt out first, to tasks of KEY_ROWS."""
    dealt = df.select(*keys, F.xxhash64(*keys).alias("_dealt")).repartition(-(-rows // KEY_ROWS) or 1, "_dealt")
    return dealt.groupBy("_dealt", *keys).count().where("count > 1").drop("_dealt")


def faults(df: DataFrame, kind: str) -> DataFrame:
    """(rule, n): the number of rows or groups that break each rule, 0 too. A rule that is null for a row is broken."""
    keys = KEYS[kind]
    rules = _rules(kind) | {f"null {k}": F.col(k).isNull() for k in keys if k not in NULLABLE_KEYS}
    row = df.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(F.coalesce(r, F.lit(True)).cast("long")), F.lit(0)).alias(name) for name, r in rules.items()]).first()
    parts = [df.sparkSession.createDataFrame(list(zip(rules, row[1:], strict=True)), "rule string, n long")]  # a row per rule
    groups = {"repeated key": repeated(df, keys, row[0])}
    if kind == "run":
        groups["ranks with gaps"] = df.groupBy("query_id", "system").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.countDistinct("rank").alias("n")).where("lo <> 1 or hi <> n")
    parts += [g.agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("n")) for name, g in groups.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def problems(df: DataFrame, kind: str) -> dict[str, int]:
    """The broken rules of :func:`faults`."""
    return {r.rule: r.n for r in faults(df, kind).where("n > 0").collect()}


def validate(df: DataFrame, kind: str, strict: bool = True) -> DataFrame:
    """The coerced table; with ``strict`` any broken rule is an error."""
    out = coerce(df, kind)
    if strict and (found := problems(out, kind)):
        raise ContractError(f"{kind}: {found}")
    return out


def save(df: DataFrame, path: str, kind: str, strict: bool = True, partition_by: list[str] | None = None) -> None:
    writer = validate(df, kind, strict).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def load(spark: SparkSession, path: str, kind: str, strict: bool = True) -> DataFrame:
    return validate(spark.read.parquet(path), kind, strict)


def single_mode(df: DataFrame, where: str = "this computation") -> DataFrame:
    """Refuse a frame that mixes condensed and uncondensed rows."""
    modes = [r[0] for r in df.select("condensed").distinct().limit(3).collect()]
    if len(modes) > 1:
        raise ContractError(f"{where} takes one ranking mode at a time, not {modes}")
    return df


def select_mode(df: DataFrame, condensed: bool = False) -> DataFrame:
    return df.where(F.col("condensed").eqNullSafe(F.lit(condensed)))
