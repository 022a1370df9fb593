"""Per-document effects: utility in one world minus utility in another.

e_rerank = U(A) - U(B), e_gate = U(A) - U(C), delta_t = U(D at t) - U(D at t = 1). A document that is
absent from a ranking has a null rank and utility 0. Rows come out for every document of the mode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import names as N
from ..functions.utility import Utility

COLUMNS = "query_id doc_id stage1_system effect_type k_c k utility condensed budget_b t policy seed stratum judged rank_treatment rank_control utility_treatment utility_control effect".split()
TYPES = {"k_c": "long", "k": "long", "condensed": "boolean", "budget_b": "long", "t": "double", "seed": "long", "judged": "boolean", "rank_treatment": "long", "rank_control": "long", "utility_treatment": "double", "utility_control": "double", "effect": "double"}


def _contract(df: DataFrame, system: str) -> DataFrame:
    """The effect table's columns in order, with typed nulls for those that do not apply."""
    out = df.withColumns({"stage1_system": F.lit(system), "effect": F.col("utility_treatment") - F.col("utility_control")})
    return out.select(*[(F.col(c) if c in out.columns else F.lit(None)).cast(TYPES.get(c, "string")).alias(c) for c in COLUMNS])


def _listed(utility: Utility | Sequence[Utility]) -> list[Utility]:
    return [utility] if isinstance(utility, Utility) else list(utility)


def stage_effects(worlds: DataFrame, utility: Utility | Sequence[Utility], system: str = "s1") -> DataFrame:
    """e_rerank and e_gate of every document in ``worlds``: two rows per utility, unpivoted in one pass."""
    each = list(enumerate(_listed(utility)))
    worth = [u.of(F.col(f"rank_{w}"), F.col("relevance")).alias(f"u_{w}_{i}") for i, u in each for w in "abc"]
    wide = worlds.select("query_id", "doc_id", "k_c", "condensed", "judged", F.when(F.col("in_cq"), N.SURVIVOR).otherwise(N.NON_SURVIVOR).alias("stratum"), "rank_a", "rank_b", "rank_c", *worth)

    def pair(kind: str, control: str, i: int, u: Utility) -> Column:
        return F.struct(
            F.lit(kind).alias("effect_type"), F.lit(u.k).alias("k"), F.lit(u.kind).alias("utility"), F.col("rank_a").alias("rank_treatment"), F.col(f"rank_{control}").alias("rank_control"),
            F.col(f"u_a_{i}").alias("utility_treatment"), F.col(f"u_{control}_{i}").alias("utility_control"),
        )

    pairs = [pair(kind, control, i, u) for i, u in each for kind, control in ((N.E_RERANK, "b"), (N.E_GATE, "c"))]
    rows = wide.withColumn("e", F.explode(F.array(*pairs))).select("query_id", "doc_id", "k_c", "condensed", "judged", "stratum", "e.*")
    return _contract(rows, system)


def budget_effects(allocated: DataFrame, utility: Utility | Sequence[Utility], system: str = "s1") -> DataFrame:
    """delta_t of every document and grid cell but t = 1, whose world is the baseline.

    The baseline is the allocation's own world at t = 1, never taken from world A; it equals A only
    where B = K_c. Several utilities are worked out on the same ranks.
    """
    sound = F.when(F.col("baseline").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit("a grid without t = 1 has no baseline")).cast("boolean"))
    rows = allocated.where(sound).where(F.col("t") != 1.0)

    def sides(u: Utility) -> Column:
        return F.struct(F.lit(u.k).alias("k"), F.lit(u.kind).alias("utility"), u.of(F.col("rank_t"), F.col("relevance")).alias("utility_treatment"), u.of(F.col("rank_1"), F.col("relevance")).alias("utility_control"))

    rows = rows.withColumn("e", F.explode(F.array(*map(sides, _listed(utility))))).select(
        "query_id", "doc_id", F.lit(N.DELTA_T).alias("effect_type"), "k_c", "condensed", F.col("budget").alias("budget_b"), "t", "policy", "seed", "stratum", "judged",
        F.col("rank_t").alias("rank_treatment"), F.col("rank_1").alias("rank_control"), "e.*",
    )
    return _contract(rows, system)


def rules(monotone: bool | Column = True) -> dict[str, Column]:
    """Conditions of rows that break the definition or a sign rule, by name; one that is null is broken.

    A survivor's e_gate is never negative and an outsider's never positive; outsiders have no
    e_rerank; removed documents never gain, selected outsiders never lose, unselected ones stay.
    The sign rules hold for monotone utilities only.
    """
    e, s, kind = F.col("effect"), F.col("stratum"), F.col("effect_type")
    sign = monotone if isinstance(monotone, Column) else F.lit(bool(monotone))
    return {
        "definition": F.abs(e - (F.col("utility_treatment") - F.col("utility_control"))) > N.EPS,
        "unknown_stratum": ~F.coalesce(*[F.when(kind == k, s.isin(*v)) for k, v in N.STRATA.items()], F.lit(False)),
        "structural_zero": F.coalesce(*[F.when(kind == k, s.isin(*v) if v else F.lit(False)) for k, v in N.STRUCTURAL_ZERO.items()], F.lit(False)) & (F.abs(e) > N.EPS),
        "gate_sign": sign & (kind == N.E_GATE) & (((s == N.SURVIVOR) & (e < -N.EPS)) | ((s == N.NON_SURVIVOR) & (e > N.EPS))),
        "budget_sign": sign & (kind == N.DELTA_T) & (((s == N.REMOVED) & (e > N.EPS)) | ((s == N.SELECTED) & (e < -N.EPS))),
        "budget_keys": (kind == N.DELTA_T) & (F.col("budget_b").isNull() | F.col("t").isNull() | F.col("policy").isNull()),
    }


def violations(effects: DataFrame, monotone: bool | Column = True, keys: Sequence[str] = ("effect_type",), *more: Column) -> DataFrame:
    """Counts of rows per effect type (or ``keys``) that break each of :func:`rules`, in one pass with ``more`` aggregates."""
    return effects.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(r, F.lit(True)).cast("long")).alias(n) for n, r in rules(monotone).items()], *more)


def additivity(stage: DataFrame) -> DataFrame:
    """Per document: e_rerank + U(B) = e_gate + U(C), both being U(A); the residual should be 0."""
    key = ["query_id", "doc_id", "stage1_system", "k_c", "k", "utility", "condensed"]

    def one(kind: str, column: str) -> Column:
        return F.max(F.when(F.col("effect_type") == kind, F.col(column)))

    wide = stage.groupBy(*key).agg(one(N.E_RERANK, "effect").alias("e_rerank"), one(N.E_GATE, "effect").alias("e_gate"), one(N.E_RERANK, "utility_control").alias("u_b"), one(N.E_GATE, "utility_control").alias("u_c"))
    return wide.withColumn("residual", F.col("e_rerank") + F.col("u_b") - F.col("e_gate") - F.col("u_c"))


def document_labels(stage: DataFrame, tau: float = 0.05) -> DataFrame:
    """One label per document: what its effects are sensitive to; a gating failure comes first."""
    key = ["query_id", "doc_id", "stage1_system", "k_c", "k", "utility", "condensed", "stratum"]

    def one(kind: str, column: str) -> Column:
        return F.max(F.when(F.col("effect_type") == kind, F.col(column)))

    wide = stage.where(F.col("effect_type").isin(N.E_RERANK, N.E_GATE)).groupBy(*key).agg(one(N.E_GATE, "effect").alias("effect_e_gate"), one(N.E_RERANK, "effect").alias("effect_e_rerank"), one(N.E_GATE, "utility_control").alias("utility_no_gate"))
    g, r = F.abs("effect_e_gate") > tau, F.abs("effect_e_rerank") > tau
    label = (
        F.when((F.col("stratum") == N.NON_SURVIVOR) & (F.col("utility_no_gate") > N.EPS), N.GATING_FAILURE)
        .when(g & r, N.JOINT).when(g, N.GATE_SENSITIVE).when(r, N.RERANK_SENSITIVE).otherwise(N.STABLE)
    )
    return wide.withColumn("label", label)


def gating_failures(stage: DataFrame, eps: float = N.EPS) -> DataFrame:
    """Outsiders that the world without a gate would rank usefully."""
    return stage.where((F.col("effect_type") == N.E_GATE) & (F.col("stratum") == N.NON_SURVIVOR) & (F.col("utility_control") > eps))


def worst_failures(stage: DataFrame, n: int = 10) -> DataFrame:
    """The n largest losses among each query's worst gating failure."""
    order = Window.partitionBy("query_id").orderBy("effect", "rank_control", "doc_id")
    worst = gating_failures(stage).withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")
    return worst.orderBy("effect", "rank_control", "query_id", "doc_id").limit(n)


def recovered_outsiders(budget: DataFrame, k: int | None = None) -> DataFrame:
    """Selected outsiders, flagged where they entered the top k."""
    cut = F.lit(k) if k is not None else F.col("k")
    return budget.where((F.col("effect_type") == N.DELTA_T) & (F.col("stratum") == N.SELECTED)).withColumn("entered_top_k", F.coalesce(F.col("rank_treatment") <= cut, F.lit(False)))
