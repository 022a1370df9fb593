"""Retrievers as queries over tables: lexical BM25, exact inner product, and stored runs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InputError
from ..operators.ranking import run_table, top_k
from .tables import scratch


def tokens(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, token) of every space-separated word."""
    return df.select(key, F.explode(F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda w: w != "")).alias("token"))


def bm25(queries: DataFrame, documents: DataFrame, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """(query_id, doc_id, score) of documents that share a word with the query.

    Only postings of words that occur in a query are kept before the join; document lengths and
    frequencies are pre-aggregated, so a hot word costs its postings once.
    """
    terms = tokens(queries, "query_id").distinct()
    posts = tokens(documents, "doc_id")
    length = documents.select("doc_id", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != "")).alias("dl"))
    facts = length.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    tf = posts.join(terms.select("token").distinct(), "token", "left_semi").groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    rows = tf.join(df, "token").join(length, "doc_id").join(F.broadcast(facts))  # facts: one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return terms.join(rows.select("token", "doc_id", weight.alias("w")), "token").groupBy("query_id", "doc_id").agg(F.sum("w").alias("score"))


def bm25_search(queries: DataFrame, documents: DataFrame, k: int, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """(query_id, doc_id, score) of each query's best ``k`` by :func:`bm25`, ties to the lesser doc_id, scores at six places.

    Texts are read twice: for the frequencies of the queries' words and the mean length, and for the scores.
    Queries are taken in blocks of at most QUERY_WORDS rows; a block's words are what is broadcast, and
    each task scores its documents in sparse products, passing on only what reaches the best k it has
    seen. So neither pairs that cannot win nor postings of hot words are shuffled.
    """
    spark = documents.sparkSession
    asked_at = scratch(spark, "query-words")
    tokens(queries, "query_id").distinct().write.parquet(asked_at)
    asked = spark.read.parquet(asked_at)
    words = asked.select("token").distinct()
    texts, tasks = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), spark.sparkContext.defaultParallelism
    if texts.rdd.getNumPartitions() < tasks:  # a small table in few files; many files stay as they are
        texts = texts.repartition(tasks)
    split = F.array_remove(F.split("text", " "), "")
    facts = texts.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(split)).alias("avgdl")).first()
    if not facts["n"] or not facts["avgdl"]:
        return spark.createDataFrame([], f"query_id string, doc_id {dict(documents.dtypes)['doc_id']}, score double")
    held = texts.select(F.explode(F.array_distinct(split)).alias("token")).join(words, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    blocks = max(1, -(-asked.count() // QUERY_WORDS))
    kind, out = dict(documents.dtypes)["doc_id"], None
    for i in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).join(held, "token").toPandas()  # at most about QUERY_WORDS rows
        if own.empty:
            continue
        names, query = np.unique(own["query_id"].to_numpy(object), return_inverse=True)
        token, word = np.unique(own["token"].to_numpy(object), return_inverse=True)
        order = np.argsort(word, kind="stable")
        starts = np.searchsorted(word[order], np.arange(len(token) + 1))
        df = own["df"].to_numpy(float)[order][starts[:-1]]
        shared = spark.sparkContext.broadcast(({t: j for j, t in enumerate(token)}, np.log(1 + (facts["n"] - df + 0.5) / (df + 0.5)), starts, query[order], names))
        part = texts.mapInArrow(_scored(shared, float(facts["avgdl"]), k, k1, b), f"query_id string, doc_id {kind}, score double")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], f"query_id string, doc_id {kind}, score double") if out is None else top_k(out, "score", k).drop("rank")


def _scored(shared, avgdl: float, k: int, k1: float, b: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, idf, starts, of, names = shared.value
        least = np.full(len(names), 0.0)
        rows = max(1, PRODUCT // max(1, len(names)))
        for batch in batches:
            docs, texts = batch.column(0), batch.column(1)
            for s in range(0, len(docs), rows):
                stop = min(len(docs), s + rows)
                score = np.zeros((stop - s, len(names)))
                for d in range(s, stop):
                    words = [w for w in texts[d].as_py().split(" ") if w]
                    counts = Counter(map(number.get, words))
                    counts.pop(None, None)
                    if counts:
                        # Words in one order, so that equal texts have equal sums.
                        t = np.sort(np.fromiter(counts.keys(), np.int64, len(counts)))
                        tf = np.array([counts[j] for j in t.tolist()], float)
                        w = idf[t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(words) / avgdl))
                        n = starts[t + 1] - starts[t]
                        at = np.repeat(starts[t] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                        score[d - s] = np.bincount(of[at], np.repeat(w, n), len(names))
                score = np.round(score, 6)
                if len(score) >= k:
                    least = np.maximum(least, np.partition(score, -k, axis=0)[-k])
                d, q = np.nonzero((score >= least) & (score > 0))
                yield pa.RecordBatch.from_arrays([pa.array(names[q], pa.string()), docs.take(pa.array(d + s)), pa.array(score[d, q])], names=["query_id", "doc_id", "score"])

    return run


def dot(a: str, b: str, first: int = 1, size: int | None = None):
    """Inner product of two arrays in double precision, over ``size`` components from ``first``."""
    x, y = (F.col(c).cast("array<double>") for c in (a, b))
    if size is not None:
        x, y = F.slice(x, first, size), F.slice(y, first, size)
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def normalised(column: str):
    """The vector at length 1; a zero vector stays."""
    x = F.col(column).cast("array<double>")
    size = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(x, lambda v: F.coalesce(F.try_divide(v, size), F.lit(0.0)))


#: Bytes of query vectors, and scores of one product, that a task holds at once.
BLOCK_BYTES, PRODUCT = 32 << 20, 4 << 20
#: Rows (query, word) of a block of queries.
QUERY_WORDS = 1_000_000


def exact_search(queries: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """Best k documents by inner product of each query's vector, a ``run`` table.

    Queries are taken in blocks of at most BLOCK_BYTES, each a broadcast matrix that meets all
    documents in one pass. A task multiplies whole Arrow batches and passes on only what reaches the
    best k it has seen so far, so no pair leaves a task for nothing. Vectors that are null, of another
    length than the queries' or not finite take no part.
    """
    spark = documents.sparkSession
    facts = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("size")).first()
    size = max(facts["size"] or 0, 1)

    def sound(df: DataFrame, key: str) -> DataFrame:
        x = F.col("vector").cast("array<double>")
        bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        return df.select(key, x.alias("vector")).where((F.size("vector") == size) & ~bad)

    blocks = max(1, -(-facts["n"] * size * 8 // BLOCK_BYTES))
    asked, corpus, out = sound(queries, "query_id"), sound(documents, "doc_id"), None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        shared = spark.sparkContext.broadcast(([r.query_id for r in own], np.array([r.vector for r in own], float).reshape(len(own), size)))
        part = corpus.mapInArrow(_nearest(shared, size, k), "query_id string, doc_id string, score double")
        out = part if out is None else out.unionByName(part)
    return run_table(out, "dense", "inner-product", depth=k)


def _nearest(shared, size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = shared.value
        names = np.array(ids, object)
        least = np.full(len(ids), -np.inf)  # what has to be reached, a little below the k-th best so far
        pairs = max(1, PRODUCT // size)
        for batch in batches:
            docs = batch.column(0)
            x = np.asarray(batch.column(1).flatten()).reshape(len(docs), size)
            # Queries are cut, not documents: of fewer than k documents all would pass.
            some = max(1, PRODUCT // max(1, len(x)))
            for a in range(0, len(ids) if len(x) else 0, some):
                own, floor = asked[a : a + some], least[a : a + some]
                score = own @ x.T
                if score.shape[1] >= k:
                    kth = np.partition(score, -k, axis=1)[:, -k]
                    np.maximum(floor, kth - 1e-9 * (1 + np.abs(kth)), out=floor)
                q, d = np.nonzero(score >= floor[:, None])
                for s in range(0, len(q), pairs):
                    qs, ds = q[s : s + pairs], d[s : s + pairs]
                    # Each pair's sum once more in one fixed order, so that equal vectors have equal scores.
                    exact = np.einsum("ij,ij->i", own[qs], x[ds])
                    yield pa.RecordBatch.from_arrays([pa.array(names[a + qs], pa.string()), docs.take(pa.array(ds)), pa.array(exact)], names=["query_id", "doc_id", "score"])

    return run


def stored_run(run: DataFrame, system: str, depth: int | None = None) -> DataFrame:
    """One system of a stored run; an unknown system or mixed checkpoints are refused."""
    own = run.where(F.col("system") == system)
    marks = [r[0] for r in own.select("checkpoint").distinct().limit(2).collect()]
    if len(marks) != 1:
        raise InputError(f"system {system!r} has {'no rows' if not marks else 'several checkpoints'}")
    return own if depth is None else own.where(F.col("rank") <= depth)
