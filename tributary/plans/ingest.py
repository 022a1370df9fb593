"""From text files and retrievers to a frozen universe and each first stage's table over it.

Artefacts lie below one folder: ``queries``, ``qrels``, ``split``, ``runs/system=…``, ``universe`` and
``stage1/system=…``. Each is written, read back and checked, and then committed to ``commits`` with its
counts; a folder that was begun with other settings is refused. A step may be done again: before it writes,
its own commit and those of all that was made from it are taken back, so a step that fails or is stopped
leaves nothing behind that counts.
"""

from __future__ import annotations

import uuid
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contracts
from ..config import Settings
from ..errors import ConfigError, InputError, UniverseError
from ..operators import judgments, ranking, universe
from ..sources import files, retrieval, trec
from ..sources.commits import CommitLog
from ..sources.tables import scratch

#: What a step is made from, so that what is stale is known. Runs and tables are named ``run:…`` and ``stage1:…``.
_AFTER = {"queries": ("run",), "run": ("universe",), "universe": ("stage1",)}


def split_table(queries: DataFrame, fractions: dict[str, float], seed: int, ranges: int = 64) -> DataFrame:
    """(query_id, split): the parts that ``config.split_queries`` gives, cut from the hash order by ranges of it."""
    if any(share < 0 for share in fractions.values()) or abs(sum(fractions.values()) - 1) > 1e-9:
        raise ConfigError("fractions of a split add up to 1")
    order = F.concat(F.sha2(F.concat(F.lit(f"{seed}/"), F.col("query_id")), 256), F.col("query_id"))
    keyed = queries.select(F.lit("").alias("query_id"), order.alias("doc_id"), F.lit(0.0).alias("score"))
    placed = ranking.rank_in_ranges(keyed, "score", "place", ranges, total="n")
    part = F.lit(list(fractions)[-1])
    for name, end in reversed([*zip(fractions, accumulate(fractions.values()), strict=True)][:-1]):
        part = F.when(F.col("place") <= F.floor(F.lit(end) * F.col("n") + 0.5), F.lit(name)).otherwise(part)
    return placed.select(F.substring("doc_id", 65, 1 << 30).alias("query_id"), part.alias("split"))


def check_depth(settings: Settings, system: str, depth: int) -> None:
    """A source has to reach the universe's depth, a first stage the deepest gate."""
    if system in (*settings.sources, *settings.optional_sources) and depth < settings.depth_m:
        raise ConfigError(f"{system} is a source of the universe, whose depth is {settings.depth_m}, not {depth}")
    if system in settings.stage1_systems and depth < max(settings.candidate_depths):
        raise ConfigError(f"{system} is a first stage and has to reach {max(settings.candidate_depths)}, not {depth}")


def depths(queries: DataFrame, run: DataFrame, depth: int) -> DataFrame:
    """(query_id, n_docs, shallow) of every query that was asked, those without an answer too."""
    got = run.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return queries.select("query_id").join(got, "query_id", "left").select("query_id", n.alias("n_docs"), (n < depth).alias("shallow"))


class Ingestion:
    def __init__(self, spark: SparkSession, path: str, settings: Settings):
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings
        self.log = CommitLog(spark, f"{self.path}/commits")
        self.log.begin(fingerprint=settings.fingerprint)

    def done(self) -> dict[str, dict]:
        """Records of the committed steps that are not stale."""
        return {part: record for part, record in self.log.done().items() if not record.get("stale")}

    def _open(self, part: str) -> None:
        """What ``part`` gave so far, and all that was made from it, no longer counts: it is about to be replaced."""
        names = stale = {part}
        while names:
            kinds = {after for name in names for after in _AFTER.get(name.partition(":")[0], ())}
            names = {p for p in self.done() if p.partition(":")[0] in kinds} - stale
            stale = stale | names
        self.log.commit({p: {"stale": True} for p in stale})

    def _commit(self, part: str, record: dict) -> dict:
        self.log.commit({part: record})
        return record

    def _need(self, *parts: str) -> None:
        if lacking := [p for p in parts if p not in self.done()]:
            raise InputError(f"{self.path}: not there or made from older results: {lacking}")

    def queries(self) -> DataFrame:
        self._need("queries")
        return self.spark.read.parquet(f"{self.path}/queries")

    def split(self) -> DataFrame:
        self._need("queries")
        return self.spark.read.parquet(f"{self.path}/split")

    def qrels(self) -> DataFrame:
        self._need("queries")
        return self.spark.read.parquet(f"{self.path}/qrels")

    def run(self, *systems: str) -> DataFrame:
        """The runs of ``systems`` (all sources unless named)."""
        wanted = systems or self.settings.sources
        self._need(*(f"run:{s}" for s in wanted))
        return _union([self.spark.read.parquet(f"{self.path}/runs/system={s}").withColumn("system", F.lit(s)) for s in wanted])

    def universe(self) -> DataFrame:
        self._need("universe")
        return files.load_frozen(self.spark, self._frozen(), self.settings.fingerprint)

    def stage1(self, system: str) -> DataFrame:
        self._need(f"stage1:{system}")
        return self.spark.read.parquet(f"{self.path}/stage1/system={system}").withColumn("system", F.lit(system))

    def _frozen(self) -> str:
        return f"{self.path}/{self.done()['universe']['folder']}"

    def prepare(self, queries: str, qrels: str) -> dict:
        """Queries, judgments and the split from text files. A grade without a gain is refused."""
        s = self.settings
        self._open("queries")
        trec.read_queries(self.spark, queries).write.mode("overwrite").parquet(f"{self.path}/queries")
        held = self.spark.read.parquet(f"{self.path}/queries")
        contracts.save(trec.read_qrels(self.spark, qrels), f"{self.path}/qrels", "qrels")
        judged = self.spark.read.parquet(f"{self.path}/qrels")
        if odd := sorted(r.relevance for r in judgments.unmapped_grades(judged, list(s.gains)).collect()):
            raise InputError(f"{qrels}: no gain for grades {odd}")
        split_table(held, s.split_fractions, s.seed).write.mode("overwrite").parquet(f"{self.path}/split")
        sizes = {r.split: r.n for r in self.spark.read.parquet(f"{self.path}/split").groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
        if lacking := set(s.split_fractions) - set(sizes):
            raise InputError(f"a part of the split is empty: {sorted(lacking)}")
        without = held.join(judged.select("query_id"), "query_id", "left_anti").count()
        return self._commit("queries", {"n_queries": held.count(), "n_judgments": judged.count(), "queries_without_judgment": without, "split_sizes": sizes, "sources": [queries, qrels]})

    def retrieve(self, system: str, corpus: DataFrame | None = None, vectors: DataFrame | None = None, stored: DataFrame | None = None, depth: int | None = None) -> dict:
        """One system's run to ``depth`` (the universe's unless given): by BM25 over ``corpus(doc_id, text)``, by inner
        product of ``vectors(query_id, vector)`` with ``corpus(doc_id, vector)``, or ``stored``, a run taken over.

        Queries with fewer documents, or none, are counted. Documents of queries that were not asked are refused.
        """
        depth = depth or self.settings.depth_m
        check_depth(self.settings, system, depth)
        if (corpus is None) == (stored is None):
            raise InputError("a run comes from a corpus or from a stored run")
        asked = self.queries()
        if stored is not None:
            names = [r.system for r in stored.select("system").distinct().limit(2).collect()]
            if len(names) != 1:
                raise InputError(f"a stored run is of one system, not {names or 'none'}")
            rows = retrieval.stored_run(stored, names[0], depth).withColumn("system", F.lit(system))
        else:
            named = corpus.withColumn("doc_id", F.col("doc_id").cast("string"))
            if vectors is None:
                rows = ranking.run_table(retrieval.bm25_search(asked, named, depth), system, "bm25 k1=0.9 b=0.4")
            else:
                own = vectors.join(asked.select("query_id"), "query_id", "left_semi")
                rows = retrieval.exact_search(own, named, depth).withColumn("system", F.lit(system))
            once = scratch(self.spark, "run")  # what checks and writes it would each search again
            rows.write.parquet(once)
            rows = self.spark.read.parquet(once)
        folder = f"{self.path}/runs/system={system}"
        self._open(f"run:{system}")
        contracts.save(rows, folder, "run")
        held = self.spark.read.parquet(folder)
        if odd := held.join(asked.select("query_id"), "query_id", "left_anti").select("query_id").distinct().limit(3).collect():
            raise InputError(f"{system}: documents of queries that were not asked, such as {[r.query_id for r in odd]}")
        n = depths(asked, held, depth).agg(F.count(F.lit(1)).alias("n"), F.sum("n_docs").alias("rows"), F.min("n_docs").alias("least"), F.percentile("n_docs", F.lit(0.5)).alias("median"), F.sum(F.col("shallow").cast("long")).alias("shallow"), F.sum((F.col("n_docs") == 0).cast("long")).alias("none")).first()
        checkpoint = held.select("checkpoint").first()
        record = {"depth": depth, "n_queries": n.n, "n_rows": n.rows or 0, "depth_min": n.least, "depth_median": n["median"], "shallow": n.shallow or 0, "without_answer": n.none or 0, "checkpoint": checkpoint and checkpoint[0]}
        return self._commit(f"run:{system}", record)

    def freeze(self) -> dict:
        """The universe of all sources' runs; every first stage's candidates have to lie in it."""
        s = self.settings
        runs = self.run()
        rows = universe.build(runs, s.depth_m, s.max_size)
        self._open("universe")
        folder = f"universe-{uuid.uuid4().hex[:12]}"  # a frozen universe is never overwritten
        files.freeze(rows, f"{self.path}/{folder}", s.fingerprint)
        held = files.load_frozen(self.spark, f"{self.path}/{folder}", s.fingerprint)
        for system in s.stage1_systems:
            universe.require_contained(runs.where(F.col("system") == system), held, max(s.candidate_depths))
        sizes = universe.sizes(held).agg(F.count(F.lit(1)).alias("n"), F.sum("n_docs").alias("pairs"), F.min("n_docs").alias("least"), F.max("n_docs").alias("most")).first()
        return self._commit("universe", {"folder": folder, "n_queries": sizes.n, "n_pairs": sizes.pairs or 0, "size_min": sizes.least, "size_max": sizes.most})

    def first_stages(self) -> dict[str, dict]:
        """Each first stage's run over the whole universe, what it did not retrieve below the rest. A table that
        disagrees with its run or its universe is refused."""
        s, held, out = self.settings, self.universe(), {}
        for system in s.stage1_systems:
            run = self.run(system)
            checkpoint = run.select("checkpoint").first()
            scored = universe.floored(run, system, held)
            folder = f"{self.path}/stage1/system={system}"
            self._open(f"stage1:{system}")
            contracts.save(universe.stage1_table(scored, system, checkpoint[0] if checkpoint else ""), folder, "run")
            table = self.spark.read.parquet(folder)
            wrong = universe.table_mismatches(table, run, held, list(s.candidate_depths)).first().asDict()
            if any(wrong.values()):
                raise UniverseError(f"{system}: {wrong}")
            floors = universe.floor_counts(scored).agg(F.sum("n_universe").alias("n"), F.sum("n_floored").alias("floored")).first()
            out[system] = self._commit(f"stage1:{system}", {"n_rows": floors.n or 0, "n_floored": floors.floored or 0})
        return out


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out
