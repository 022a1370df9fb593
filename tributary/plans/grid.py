"""The whole study in one plan: every depth, share, policy, seed, mode and utility as effect rows.

The grid is written once, partitioned by what later reports select on, so they prune folders instead
of opening tables by name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .. import contracts
from ..config import Settings
from ..errors import ContractError
from ..functions.utility import Utility
from ..operators import allocation, effects, ranking, worlds
from ..sources.commits import CommitLog, content, digest

PARTITIONS = ["stage1_system", "utility", "k", "kind", "k_c", "condensed"]


def effect_grid(cascade: DataFrame, settings: Settings, system: str, utilities: Sequence[Utility] | None = None, modes: Sequence[bool] = (False, True), optional_t: bool = False) -> DataFrame:
    """Stage and budget effects of one first stage over the settings' grid.

    Both orders of a query are ranked once; depths, allocations, modes and utilities multiply the
    ranked rows afterwards.
    """
    own = utilities or [Utility(u, k, settings.persistence, settings.gains) for u, k in settings.settings()]
    depths = list(settings.candidate_depths)
    ranked = worlds.kept(cascade)
    both = worlds.from_ranked(ranked, depths, list(modes))
    budget = None if settings.b_equals_kc else settings.b_absolute
    grid = allocation.parameters(cascade.sparkSession, depths, settings.grid_t(optional_t), settings.policies, settings.budget_seeds, budget)
    spent = allocation.in_modes(allocation.allocate(worlds.from_ranked(ranked, depths), grid), modes)
    return effects.stage_effects(both, own, system).unionByName(effects.budget_effects(spent, own, system))


def write_grid(effects_: DataFrame, path: str) -> None:
    """Write effect rows that keep their contract; ``kind`` tells stage from budget effects.

    What breaks the contract or, for monotone utilities, a sign rule is refused before anything is
    written.
    """
    rows = contracts.validate(effects_, "effect")
    for name in (r.utility for r in rows.select("utility").distinct().collect()):  # a handful of settings
        for r in effects.violations(rows.where(F.col("utility") == name), Utility(name).monotone).collect():
            if broken := {c: r[c] for c in r.asDict() if c not in ("effect_type", "n") and r[c]}:
                raise ContractError(f"{name}, {r.effect_type}: {broken}")
    rows = rows.withColumn("kind", F.when(F.col("effect_type") == "delta_t", "budget").otherwise("stage"))
    rows.write.mode("overwrite").partitionBy(*PARTITIONS).parquet(path)


def read_grid(spark, path: str, system: str | None = None, k_c: int | None = None, kind: str | None = None, condensed: bool | None = None) -> DataFrame:
    """Effect rows of a written grid; what is given prunes folders."""
    rows = spark.read.parquet(path)
    for c, v in (("stage1_system", system), ("k_c", k_c), ("kind", kind), ("condensed", condensed)):
        rows = rows if v is None else rows.where(F.col(c) == F.lit(v))
    return rows


def allocation_mismatches(first: DataFrame, second: DataFrame) -> DataFrame:
    """Promoted outsiders that only one of two allocation tables has, per run; null seeds are equal."""
    key = ["query_id", "k_c", "t", "policy", "seed", "doc_id"]
    both = first.select(*key, F.lit(True).alias("a")).unionByName(second.select(*key, F.lit(False).alias("a")))
    sides = both.groupBy(*key).agg(F.bool_or("a").alias("in_first"), F.bool_or(~F.col("a")).alias("in_second"))
    return sides.where("in_first <> in_second")


def promoted(allocated: DataFrame) -> DataFrame:
    """The published allocation table: outsiders in the order of their place, per run."""
    return allocated.where("stratum = 'selected_outsider'").select("query_id", "k_c", "t", "policy", "seed", "doc_id", F.row_number().over(_place()).alias("promoted_rank"))


def _place():
    from pyspark.sql.window import Window

    return Window.partitionBy("query_id", "k_c", "t", "policy", "seed").orderBy(F.when(F.col("policy") == "boundary", F.col("rank_s1")).otherwise(F.coalesce("alt_rank", F.lit(1 << 30))), "doc_id")


# The grid cell by cell, for studies that are stopped and go on

KEY = ["query_id", "doc_id"]
#: What tells the rows of one document apart.
SETTING = [c for c in contracts.KEYS["effect"] if c not in KEY]


def cell_names(settings: Settings, system: str) -> list[tuple[str, int, str | None]]:
    """(name, k_c, policy) of each cell: the stage effects of a depth, and its budget effects by policy."""
    return [(f"{system}-k{k_c}-{policy or 'stage'}", k_c, policy) for k_c in settings.candidate_depths for policy in (None, *settings.policies)]


def write_cells(cascade: DataFrame, settings: Settings, system: str, path: str, utilities: Sequence[Utility] | None = None, modes: Sequence[bool] = (False, True), optional_t: bool = False, before_commit: Callable[[str], None] | None = None) -> dict[str, list[str]]:
    """The grid of one system below ``path``, a folder and a commit for each cell.

    A cell is written, checked against its contract and the sign rules on what was written, and then
    committed with its counts; cells that are committed are not worked out again, and what a stopped run
    left without a commit is replaced. Both orders are ranked once, on disk, and only if a cell is left
    to do. Another cascade, other settings and documents that a query has twice are refused. ``before_commit``
    is called with each cell's name.
    """
    spark = cascade.sparkSession
    own = utilities or [Utility(u, k, settings.persistence, settings.gains) for u, k in settings.settings()]
    log = CommitLog(spark, f"{path}-commits")
    log.begin(fingerprint=settings.fingerprint, cascade=content(cascade, *worlds.COLUMNS).first().digest, modes=list(map(bool, modes)), utilities=sorted(f"{u.kind}@{u.k}" for u in own), optional_t=optional_t)
    done = log.done()
    cells = cell_names(settings, system)
    todo = [c for c in cells if c[0] not in done]
    if todo:
        ranges = ranking.ranges_for(cascade)
        ranked = worlds.kept(cascade, ranges)
        held = {m: content(ranked.where("judged") if m else ranked, *KEY).first() for m in (False, True)}
        if n := contracts.repeated(ranked, KEY, held[False].rows).count():
            raise ContractError(f"cascade: {{'repeated key': {n}}}")
    budget = None if settings.b_equals_kc else settings.b_absolute
    for name, k_c, policy in todo:
        record: dict = {}
        if policy is None:
            rows = effects.stage_effects(worlds.from_ranked(ranked, [k_c], list(modes)), own, system)
        else:
            cells_ = allocation.parameters(spark, [k_c], settings.grid_t(optional_t), [policy], settings.budget_seeds, budget)
            spent = allocation.allocate(worlds.from_ranked(ranked, [k_c]), cells_, ranges)
            agreed = worlds.baseline_agreement(spent).agg(F.count(F.lit(1)).alias("runs"), F.sum((~F.col("agrees")).cast("long")).alias("disagree")).first()
            record = {"baselines": agreed.runs, "baselines_that_differ": agreed.disagree or 0}
            if record["baselines_that_differ"]:
                raise ContractError(f"{name}: {record['baselines_that_differ']} of {agreed.runs} worlds at t = 1 are not the baseline")
            rows = effects.budget_effects(allocation.in_modes(spent, modes), own, system)
        folder = f"{path}/cell={name}"
        rows.write.mode("overwrite").parquet(folder)
        n = _checked(spark.read.parquet(folder), name, own, held)
        if before_commit:
            before_commit(name)
        log.commit({name: {"rows": n, "k_c": k_c, "policy": policy, **record}})
    return {"written": [c[0] for c in todo], "held": [c[0] for c in cells if c[0] in done]}


def _checked(rows: DataFrame, name: str, own: Sequence[Utility], held: dict[bool, Row]) -> int:
    """The number of a cell's rows, or an error where one breaks the contract or a sign rule, or where a setting's
    documents are not those of its mode (``held``, by condensed), each once.

    One pass that moves no row: the cascade has no document twice, so where a setting's number and digest of
    documents are the cascade's, no key is null, lacks or repeats.
    """
    monotone = F.lit(False)
    for u in own:
        monotone = F.when((F.col("utility") == u.kind) & (F.col("k") == u.k), F.lit(u.monotone)).otherwise(monotone)
    n = 0
    for r in effects.violations(contracts.coerce(rows, "effect"), monotone, SETTING, digest(*KEY).alias("digest")).collect():  # a row per setting
        setting = {c: r[c] for c in SETTING}
        broken = {c: r[c] for c in effects.rules() if r[c]} | {f"null {c}": r["n"] for c in SETTING if r[c] is None and c not in contracts.NULLABLE_KEYS}
        if not broken and (r["n"], r["digest"]) != (held[r["condensed"]].rows, held[r["condensed"]].digest):
            broken = {"rows": r["n"], "not those of documents": held[r["condensed"]].rows}
        if broken:
            raise ContractError(f"{name}, {setting}: {broken}")
        n += r["n"]
    return n


def cell_records(spark, path: str) -> DataFrame:
    """(cell, k_c, policy, rows, baselines, baselines_that_differ) of the committed cells."""
    fields = "rows long, k_c long, policy string, baselines long, baselines_that_differ long"
    return CommitLog(spark, f"{path}-commits").table().select(F.col("part").alias("cell"), F.from_json("record", fields).alias("r")).select("cell", "r.k_c", "r.policy", "r.rows", "r.baselines", "r.baselines_that_differ")


def read_cells(spark, path: str, k_c: int | None = None, policy: str | None = None) -> DataFrame:
    """Effect rows of committed cells, of one depth and (None: the stage effects and all) one policy."""
    chosen = cell_records(spark, path)
    chosen = chosen if k_c is None else chosen.where(F.col("k_c") == k_c)
    chosen = chosen if policy is None else chosen.where(F.col("policy") == policy)
    names = [r.cell for r in chosen.collect()]  # a row per cell
    if not names:
        raise ContractError(f"no cell is committed at {path}")
    return spark.read.parquet(*[f"{path}/cell={n}" for n in sorted(names)])
