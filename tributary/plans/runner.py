"""A study as named steps over written tables, recomputed only where something changed.

A step's mark is made of the contents of the tables it reads, of the settings and of its own version.
A step whose mark is committed is not run again; its table is read. Contents, not paths or times, count,
so a table that was written again with the same rows changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..errors import InputError
from ..operators import effects, resample, summaries
from ..sources.commits import CommitLog, content, mark_of


#: Steps whose tables are written at the same time.
AT_ONCE = 4


@dataclass(frozen=True)
class Step:
    """A table made of others: inputs or earlier steps by name. A new ``version`` makes it run again."""

    name: str
    reads: tuple[str, ...]
    make: Callable[..., DataFrame]
    version: int = 1


class Study:
    def __init__(self, spark: SparkSession, path: str, settings: Settings, steps: list[Step]):
        self.spark, self.path, self.settings, self.steps = spark, path, settings, steps
        self.log = CommitLog(spark, f"{path}/commits")

    def run(self, **inputs: DataFrame) -> dict[str, bool]:
        """Bring all steps up to date; whether each was worked out now (or else found).

        A step waits for the tables that it reads only: tables of several steps are written at a time, so tasks of
        one fill the cores that the last tasks of another, or its small jobs, leave idle.
        """
        marks, tables, done, ran, lock = {}, dict(inputs), self.log.done(), {}, Lock()
        for name, df in inputs.items():
            facts = content(df, *sorted(df.columns)).first()
            marks[name] = f"{facts['rows']}:{facts.digest}"

        def write(name: str, df: DataFrame, place: str) -> DataFrame:
            df.write.mode("overwrite").parquet(place)
            held = self.spark.read.parquet(place)
            rows = held.count()
            with lock:  # two jobs that append to the log at once would clear each other's files
                self.log.commit({name: {"mark": marks[name], "rows": rows}})
            return held

        def held(name: str) -> DataFrame:
            if isinstance(tables[name], Future):
                tables[name] = tables[name].result()
            return tables[name]

        with ThreadPoolExecutor(AT_ONCE) as pool:
            for step in self.steps:
                if lacking := set(step.reads) - set(tables):
                    raise InputError(f"step {step.name} reads {sorted(lacking)}, which no input or earlier step is")
                marks[step.name] = mark_of(step=step.name, version=step.version, settings=self.settings.fingerprint, reads={r: marks[r] for r in step.reads})
                place = f"{self.path}/{step.name}/{marks[step.name]}"
                ran[step.name] = done.get(step.name, {}).get("mark") != marks[step.name]
                if ran[step.name]:
                    tables[step.name] = pool.submit(inheritable_thread_target(self.spark)(write), step.name, step.make(*map(held, step.reads)), place)
                else:
                    tables[step.name] = self.spark.read.parquet(place)
            for step in self.steps:
                held(step.name)
        return ran

    def table(self, name: str) -> DataFrame:
        """The last committed result of a step."""
        record = self.log.done().get(name)
        if record is None:
            raise InputError(f"step {name} has not been run at {self.path}")
        return self.spark.read.parquet(f"{self.path}/{name}/{record['mark']}")


def _own(settings: Settings, kind: str) -> Callable[[DataFrame], DataFrame]:
    """Rows of the headline utility in the whole ranking."""

    def of(rows: DataFrame) -> DataFrame:
        some = F.col("effect_type") == "delta_t" if kind == "budget" else F.col("effect_type") != "delta_t"
        return rows.where(some & (F.col("utility") == settings.utility) & (F.col("k") == settings.k) & ~F.col("condensed"))

    return of


def analysis(settings: Settings, draws: int = 1000, permutations: int = 10_000) -> list[Step]:
    """Steps over ``effects``: diagnosis, distributions, outcomes, tests and intervals of one first stage."""
    both = ["policy", "t"]

    def joined(diagnosis: DataFrame, outcomes: DataFrame) -> DataFrame:
        return outcomes.join(diagnosis.select("query_id", "k_c", "label", "g_q"), ["query_id", "k_c"]).where(F.col("k_c") == settings.candidate_depths[0])

    def headline(df: DataFrame) -> DataFrame:
        return df.where(F.col("k_c") == settings.candidate_depths[0])

    return [
        Step("stage", ("effects",), _own(settings, "stage")),
        Step("budget", ("effects",), _own(settings, "budget")),
        Step("diagnosis", ("stage",), lambda s: summaries.diagnose(s, settings.tau_query)),
        Step("distributions", ("stage",), summaries.distributions),
        Step("unjudged", ("stage",), summaries.unjudged_at_k),
        Step("failures", ("stage",), effects.gating_failures),
        Step("outcomes", ("budget",), summaries.budget_outcomes),
        Step("groups", ("diagnosis", "outcomes"), summaries.outcomes_by_label),
        Step("test", ("diagnosis", "outcomes"), lambda d, o: resample.h7_permutations(headline(d), headline(o), permutations, settings.seed)),
        Step("intervals", ("diagnosis", "outcomes"), lambda d, o: resample.replicate_intervals(resample.group_sums(joined(d, o), both), both, resample.GROUPS, resample.GROUP_SUMS, draws, seed=settings.seed)),
    ]


def comparison(settings: Settings, first: str, second: str) -> list[Step]:
    """Steps over the ``effects`` of two systems: metrics of all settings, one axis at a time side by side."""
    headline = {"k_c": settings.candidate_depths[0], "utility": settings.utility, "k": settings.k, "condensed": False}
    return [
        Step("metrics", ("effects",), lambda e: summaries.setting_metrics(e.where("effect_type <> 'delta_t'"), settings.tau_query).unionByName(summaries.outcome_metrics(e.where("effect_type = 'delta_t'")))),
        Step("one_axis", ("metrics",), lambda m: summaries.one_axis(m, headline, first, second)),
    ]


def outsiders(settings: Settings, n_queries: int) -> list[Step]:
    """Steps over ``effects`` and ``qrels``: who was promoted, and which failures a policy left out."""
    relevant = min((g for g, v in settings.gains.items() if v > 0), default=0)
    return [
        Step("stage", ("effects",), _own(settings, "stage")),
        Step("budget", ("effects",), _own(settings, "budget")),
        Step("promotion", ("budget", "stage", "qrels"), lambda b, s, q: summaries.promotion(b, s, q.where(F.col("relevance") >= relevant), n_queries)),
        Step("false_negatives", ("budget", "stage"), summaries.false_negatives),
    ]
