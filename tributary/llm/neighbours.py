"""Approximate nearest neighbours by inner product, with a probabilistic stopping test.

Vectors get one more component so that the largest inner product becomes the least Euclidean
distance, and are projected with Gaussian (2-stable) weights to a few dimensions. There a squared
projected distance is the true one times a chi-square variable, so a kd-tree over the projections
can hand out neighbours by growing projected distance: leaf by leaf, and of a leaf only those vectors
whose own projected distance passes the test are verified on the original ones. The search ends once
the chi-square distribution leaves the next ones too little chance to be among the best.

On Spark the upper levels of the kd-tree are cells that vectors are dealt to; each cell's chunks hold
their own lower levels. A first wave searches every query's own chunk and gives a bound; a second
visits the chunks whose boxes pass the same test under that bound and returns only what reaches it.
Of identical vectors only the k + 1 least ids can be in any answer; the others are set aside by a
window limit before the index is built.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import groups, written

PROJECTED = 16
#: Chance at least that a true neighbour is verified.
SURE = 0.96
#: Vectors whose projections place the cells; vectors of a cell; most cells; sizes of chunks, query blocks and leaves.
SAMPLE, CELL, MOST_CELLS = 20_000, 8192, 4096
CHUNK, BLOCK, LEAF = 16_384, 1024, 64


def chi_square(x: np.ndarray, m: int = PROJECTED) -> np.ndarray:
    """Distribution function of chi-square with an even number of degrees of freedom."""
    half = np.minimum(np.asarray(x, float) / 2, 700.0)
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, m // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def quantile(p: float, m: int = PROJECTED) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if float(chi_square(np.array(mid), m)) < p else (lo, mid)
    return hi


def weights(dimension: int, m: int = PROJECTED, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dimension + 1, m))


def project(x: np.ndarray, w: np.ndarray, longest: float | None) -> np.ndarray:
    """Projections of vectors, or with ``longest`` None of queries, whose added component is 0."""
    out = x @ w[:-1]
    return out if longest is None else out + np.sqrt(np.maximum(0, longest - np.einsum("ij,ij->i", x, x)))[:, None] * w[-1]


class Cells:
    """Upper levels of the kd-tree: a complete binary tree of medians of a sample."""

    def __init__(self, sample: np.ndarray, count: int):
        self.depth = max(0, min(int(log2(MOST_CELLS)), int(np.ceil(log2(max(1, count / CELL))))))
        self.axis = np.zeros((1 << self.depth) - 1, np.int64)
        self.cut = np.zeros((1 << self.depth) - 1)
        parts = {0: sample}
        for node in range(len(self.axis)):
            own = parts.pop(node, sample[:0])
            if len(own):
                self.axis[node] = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                self.cut[node] = float(np.median(own[:, self.axis[node]]))
            right = own[:, self.axis[node]] > self.cut[node]
            parts[2 * node + 1], parts[2 * node + 2] = own[~right], own[right]

    def of(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), np.int64)
        rows = np.arange(len(p))
        for _ in range(self.depth):
            node = 2 * node + 1 + (p[rows, self.axis[node]] > self.cut[node])
        return node - ((1 << self.depth) - 1)


def _leaves(p: np.ndarray) -> list[np.ndarray]:
    """Row numbers of the kd-tree's leaves: split at the middle of the widest axis."""
    out, work = [], [np.arange(len(p))]
    while work:
        rows = work.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        own = p[rows]
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        half = len(rows) // 2
        order = np.argpartition(own[:, axis], half)
        work += [rows[order[:half]], rows[order[half:]]]
    return out


def search(ids: np.ndarray, x: np.ndarray, qid: np.ndarray, q: np.ndarray, bound: np.ndarray, w: np.ndarray, longest: float, k: int, sure: float = SURE) -> tuple[list[tuple[int, int, float]], int]:
    """(query, vector, score) of each query's best k in one chunk among those that reach its bound, and how
    many pairs were verified."""
    p, pq = project(x, w, longest), project(q, w, None)
    leaves = _leaves(p)
    width = max(map(len, leaves))
    rows = np.stack([np.r_[r, np.full(width - len(r), -1)] for r in leaves])
    low, high = np.stack([p[r].min(axis=0) for r in leaves]), np.stack([p[r].max(axis=0) for r in leaves])
    limit = quantile(sure)
    out: list[tuple[int, int, float]] = []
    verified = 0
    for s in range(0, len(q), 128):
        mine, vec, place = qid[s : s + 128], q[s : s + 128], pq[s : s + 128]
        gap = np.maximum(0, np.maximum(low - pq[s : s + 128, None], pq[s : s + 128, None] - high))
        far = np.einsum("qld,qld->ql", gap, gap)
        order = np.argsort(far, axis=1, kind="stable")
        size = np.einsum("ij,ij->i", vec, vec) + longest
        best = np.full((len(vec), k), -np.inf)
        best_id = np.full((len(vec), k), np.iinfo(np.int64).max)
        floor = bound[s : s + 128].copy()
        for turn in range(len(leaves)):
            leaf = order[:, turn]
            # Squared distance of the k-th best so far; the test asks how likely a nearer one lies beyond.
            worst = np.maximum(best[:, -1], floor)
            reach = np.maximum(0, size - 2 * worst) * limit
            on = np.flatnonzero(~(far[np.arange(len(vec)), leaf] > reach))
            if not len(on):
                break
            at = rows[leaf[on]]
            apart = p[at] - place[on, None]
            near = ~(np.einsum("qld,qld->ql", apart, apart) > reach[on, None]) & (at >= 0) & (ids[at] != mine[on, None])
            i, j = np.nonzero(near)
            verified += len(i)
            score = np.full(at.shape, -np.inf)
            score[i, j] = np.einsum("nd,nd->n", x[at[i, j]], vec[on[i]])
            score[score < floor[on, None]] = -np.inf
            every = np.concatenate([best[on], score], axis=1)
            names = np.concatenate([best_id[on], np.where(np.isfinite(score), ids[at], np.iinfo(np.int64).max)], axis=1)
            top = np.lexsort((names, -every), axis=1)[:, :k]
            best[on], best_id[on] = np.take_along_axis(every, top, 1), np.take_along_axis(names, top, 1)
        i, j = np.nonzero(np.isfinite(best))
        out += zip(mine[i].tolist(), best_id[i, j].tolist(), best[i, j].tolist(), strict=True)
    return out, verified


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) with x as doubles: no null, zero or other-length vectors, only finite components."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).where("vec_id is not null and x is not null and size(x) > 0")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(finite).where(F.exists("x", lambda v: v != 0))
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).select("d")
    return rows.join(F.broadcast(common), F.size("x") == F.col("d"), "left_semi")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, sure: float = SURE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of largest inner product found for each query.

    Queries are the usable rows of ``vectors(vec_id, embedding)`` whose vec_id is divisible by
    ``every``; candidates are all usable rows but the query's own id. Scores are inner products of
    the vectors as given, in double precision; equal scores go to the smaller id, and rows that
    repeat an id count once for each different vector. Vectors that are null, zero, of another
    length than most, or hold null or non-finite components take no part. With fewer than k
    candidates all are returned; an empty table gives an empty table. Other columns are ignored.
    """
    spark = vectors.sparkSession
    clean = written(usable(vectors).distinct(), "vectors")
    facts = clean.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)).alias("longest"), F.max(F.size("x")).alias("d")).first()
    result = "query_id long, vec_id long, score double"
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    longest, w = float(facts["longest"]), weights(int(facts["d"]))
    same = Window.partitionBy(F.xxhash64("x"), "x").orderBy("vec_id")
    stored = clean.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).drop("copy")
    sample = clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    cells = Cells(project(np.stack(sample["x"]), w, longest), int(facts["n"]))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                p = project(np.stack(pdf["x"]), w, longest)
                yield pdf.assign(cell=cells.of(p).astype("int32"), p=list(p))

    placed = written(stored.mapInPandas(place, "vec_id long, x array<double>, cell int, p array<double>"), "placed")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    placed = placed.join(F.broadcast(sizes), "cell").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int"))
    placed = written(placed, "chunks")
    m = w.shape[1]
    edges = [f(F.get("p", F.lit(i))).alias(f"{n}{i}") for i in range(m) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    # One box a cell, MOST_CELLS at most, whatever the number of vectors.
    boxes = placed.groupBy("cell").agg(*edges).orderBy("cell").toPandas()
    low_edge, high_edge = (boxes[[f"{n}{i}" for i in range(m)]].to_numpy(float) for n in ("lo", "hi"))
    numbers = boxes["cell"].to_numpy()

    def search_all(visits: DataFrame) -> DataFrame:
        """visits(query_id, q, bound, cell, chunk) -> scored pairs that reach the bound."""
        blocks = visits.groupBy("cell", "chunk").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        asked = visits.join(blocks, ["cell", "chunk"]).select("cell", "chunk", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"), F.col("query_id").alias("id"), F.col("q").alias("x"), "bound")
        held = placed.join(blocks, ["cell", "chunk"]).select("cell", "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("vec_id").alias("id"), "x", F.lit(None).cast("double").alias("bound"))
        key = ["cell", "chunk", "block"]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for g in groups(batches, key):
                is_q = g["bound"].notna().to_numpy()
                if is_q.all() or not is_q.any():
                    continue
                x, ids = np.stack(g["x"]), g["id"].to_numpy(np.int64)
                found, _ = search(ids[~is_q], x[~is_q], ids[is_q], x[is_q], g["bound"].to_numpy(float)[is_q], w, longest, k, sure)
                if found:
                    yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

        rows = held.unionByName(asked)
        return rows.repartition(*key).sortWithinPartitions(*key).mapInPandas(run, result)

    queries = clean.where(F.col("vec_id") % every == 0).select("vec_id", "x")

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"])
                yield pd.DataFrame({"query_id": pdf["vec_id"], "q": list(x), "cell": cells.of(project(x, w, longest)).astype("int32"), "pq": list(project(x, w, None))})

    asked = written(queries.mapInPandas(home, "query_id long, q array<double>, cell int, pq array<double>"), "queries")
    low = F.lit(-1e300)
    own = asked.join(F.broadcast(sizes), "cell", "left").select("query_id", "q", low.alias("bound"), "cell", F.pmod(F.xxhash64("query_id"), F.coalesce("chunks", F.lit(1))).cast("int").alias("chunk"))
    first = written(search_all(own), "first-wave")
    bound = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(low).alias("bound"))
    limit = quantile(sure)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cells whose box leaves a vector within the query's bound the chance asked for."""
        for pdf in batches:
            if len(pdf):
                pq, q = np.stack(pdf["pq"]), np.stack(pdf["q"])
                reach = np.maximum(0, np.einsum("ij,ij->i", q, q) + longest - 2 * pdf["bound"].to_numpy(float)) * limit
                gap = np.maximum(0, np.maximum(low_edge - pq[:, None], pq[:, None] - high_edge))
                i, j = np.nonzero(np.einsum("qcd,qcd->qc", gap, gap) <= reach[:, None])
                yield pdf[["query_id", "q", "bound"]].iloc[i].assign(cell=numbers[j])

    bounded = asked.drop("cell").join(bound, "query_id", "left").withColumn("bound", F.coalesce("bound", low))
    visits = bounded.mapInPandas(route, "query_id long, q array<double>, bound double, cell int").join(F.broadcast(sizes), "cell")
    visits = visits.select("query_id", "q", "bound", "cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    found = search_all(written(visits, "visits")).distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
