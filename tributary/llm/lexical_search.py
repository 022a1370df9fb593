"""Ranked lexical search by branch and bound over hierarchical max trees.

Documents are cut into segments, ranges of documents as they are stored. A segment has the postings of
the terms that queries ask for, and for each term a tree over its documents: a node knows the largest
impact of the term below it. Segments in turn are the leaves of a tree that Spark aggregates, again with
the largest impact per term and node.

The sum of a query's term maxima is a bound on every score below a node. Each query first descends the
segment tree along the highest bounds to one segment; its k-th score there is a floor that no result can
fall below. Then every segment is searched best first: the node of highest bound is opened, until the
highest bound left is below the floor or the k-th score found. Nodes whose bound equals it are opened,
since a tie may have a smaller doc_id. So the result is exact.

Queries are taken in blocks of bounded size: a block's terms are what is broadcast.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import _values, bounded_batches, written

#: Children of a node; documents and postings of a segment; rows (query, term) of a block of queries.
FAN, SEGMENT_DOCS, SEGMENT_POSTINGS, QUERY_TERMS = 16, 4096, 1 << 20, 500_000
_SHIFT = FAN.bit_length() - 1
#: Bytes of terms stay, A-Z as a-z, all others become spaces; bytes of other than ASCII characters stay.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_SEGMENT = [
    ("part", "long", pa.int64()), ("seq", "long", pa.int64()), ("n_docs", "long", pa.int64()), ("n_terms", "long", pa.int64()), ("doc_ids", "array<long>", pa.list_(pa.int64())), ("lengths", "array<long>", pa.list_(pa.int64())),
    ("terms", "array<int>", pa.list_(pa.int32())), ("docs", "array<int>", pa.list_(pa.int32())), ("tfs", "array<long>", pa.list_(pa.int64())),
]


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of letters, digits and characters outside ASCII, A-Z as a-z."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split() if text else []


def segments(documents: DataFrame, vocabulary) -> DataFrame:
    """Segments of ``documents`` over the terms of the broadcast ``vocabulary`` (term -> number).

    Postings are sorted by term and document; ``docs`` number the segment's ``doc_ids``. n_docs and
    n_terms count all documents with terms, those without a term of the vocabulary too.
    """
    bounded_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part = vocabulary.value, TaskContext.get().partitionId()
        ids, lengths, n_docs, n_terms, found, held, seq = [], [], 0, 0, [], 0, 0

        def row() -> pa.RecordBatch:
            term = np.concatenate([np.fromiter(c.keys(), np.int32, len(c)) for c in found] or [np.empty(0, np.int32)])
            tf = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in found] or [np.empty(0, np.int64)])
            doc = np.repeat(np.arange(len(found), dtype=np.int32), [len(c) for c in found])
            order = np.argsort(term, kind="stable")
            values = [part, seq, n_docs, n_terms, ids, lengths, term[order], doc[order], tf[order]]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, _, t) in zip(values, _SEGMENT, strict=True)], names=[s[0] for s in _SEGMENT])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = terms_of(text)
                if not words:
                    continue
                n_docs, n_terms = n_docs + 1, n_terms + len(words)
                counts = Counter(map(known.get, words))
                counts.pop(None, None)
                if counts:
                    ids.append(doc)
                    lengths.append(len(words))
                    found.append(counts)
                    held += len(counts)
                if len(ids) >= SEGMENT_DOCS or held >= SEGMENT_POSTINGS:
                    yield row()
                    ids, lengths, n_docs, n_terms, found, held, seq = [], [], 0, 0, [], 0, seq + 1
        if n_docs:
            yield row()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t, _ in _SEGMENT))


class Tree:
    """The max trees of all terms of one segment; level 0 has the impacts of documents."""

    def __init__(self, doc_ids, lengths, terms, docs, tfs, weights: np.ndarray, n: int, total: int):
        self.doc_ids = doc_ids
        m = np.array([25 + 75 * int(x) * n // total for x in lengths], np.int64)
        value = weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m[docs]))
        term, node, width = terms.astype(np.int64), docs.astype(np.int64), max(1, len(doc_ids))
        self.levels = [(term * width + node, value, width)]
        while width > 1 and len(term):
            node, width = node >> _SHIFT, (width + FAN - 1) >> _SHIFT
            key = term * width + node
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            value, term, node = np.maximum.reduceat(value, first), term[first], node[first]
            self.levels.append((key[first], value, width))

    def root(self, size: int) -> np.ndarray:
        """The largest impact of each of ``size`` terms."""
        out = np.zeros(size, np.int64)
        keys, values, _ = self.levels[-1]
        out[keys] = values
        return out

    def below(self, level: int, node: int, terms: np.ndarray, times: np.ndarray) -> tuple[int, np.ndarray]:
        """(first child, bounds of the children) of a node."""
        keys, values, width = self.levels[level - 1]
        a, b = node << _SHIFT, min((node + 1) << _SHIFT, width)
        base = terms * width + a
        lo, hi = np.searchsorted(keys, base), np.searchsorted(keys, base + (b - a))
        n = hi - lo
        at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        out = np.zeros(b - a, np.int64)
        np.add.at(out, keys[at] - np.repeat(base, n), values[at] * np.repeat(times, n))
        return a, out

    def search(self, terms: np.ndarray, times: np.ndarray, bound: int, floor: int, k: int, best: list[tuple[int, int]]) -> int:
        """Put documents that score ``floor`` or more into the heap ``best`` of (score, -doc_id); nodes opened."""
        work, opened = [(-bound, len(self.levels) - 1, 0)], 0
        if len(self.levels) == 1:
            self._offer(0, np.array([bound]), floor, k, best)
            return 1
        while work:
            bound, level, node = heapq.heappop(work)
            least = max(floor, best[0][0] if len(best) == k else 1)
            if -bound < least:
                break
            opened += 1
            first, bounds = self.below(level, node, terms, times)
            if level == 1:
                self._offer(first, bounds, least, k, best)
            else:
                for i in np.flatnonzero(bounds >= least).tolist():
                    heapq.heappush(work, (-int(bounds[i]), level - 1, first + i))
        return opened

    def _offer(self, first: int, scores: np.ndarray, least: int, k: int, best: list[tuple[int, int]]) -> None:
        for i in np.flatnonzero(scores >= max(least, 1)).tolist():
            found = (int(scores[i]), -int(self.doc_ids[first + i]))
            if len(best) < k:
                heapq.heappush(best, found)
            elif found > best[0]:
                heapq.heapreplace(best, found)


def _trees(batches: Iterator[pa.RecordBatch], weights: np.ndarray, n: int, total: int) -> Iterator[tuple[int, Tree]]:
    for batch in batches:
        for segment, *columns in zip(*(_values(batch.column(i)) for i in range(6)), strict=True):
            yield segment, Tree(*columns, weights, n, total)


class _Block:
    """Queries of one block: their ids, terms and weights, as numpy arrays for the tasks."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["item_id", "term"], ignore_index=True)
        self.items, query = np.unique(rows["item_id"].to_numpy(np.int64), return_inverse=True)
        words, self.terms = np.unique(rows["term"].to_numpy(object), return_inverse=True)
        self.vocabulary = {bytes(w): i for i, w in enumerate(words)}
        self.times = rows["times"].to_numpy(np.int64)
        self.starts = np.searchsorted(query, np.arange(len(self.items) + 1))

    def query(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.starts[q], self.starts[q + 1]
        return self.terms[a:b], self.times[a:b]

    def bounds(self, tree: Tree) -> np.ndarray:
        """The bound of every query at the root of a segment."""
        return np.add.reduceat(tree.root(len(self.vocabulary))[self.terms] * self.times, self.starts[:-1])


def _searched(rows: DataFrame, shared, n: int, total: int, k: int, asked: dict[int, list[int]] | None, floors: np.ndarray) -> DataFrame:
    """(query, doc_id, score): the k best of each task's segments; ``asked`` limits a segment to some queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weights = shared.value
        best: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for segment, tree in _trees(batches, weights, n, total):
            bounds = block.bounds(tree)
            for q in range(len(bounds)) if asked is None else asked.get(segment, ()):
                if bounds[q] and bounds[q] >= max(floors[q], best[q][0][0] if len(best[q]) == k else 0):
                    tree.search(*block.query(q), int(bounds[q]), int(floors[q]), k, best[q])
        found = [(q, -d, s) for q, heap in best.items() for s, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["query", "doc_id", "score"])

    return rows.mapInArrow(run, "query long, doc_id long, score long")


def _search_block(documents: DataFrame, block: _Block, k: int) -> DataFrame | None:
    spark = documents.sparkSession
    sc = spark.sparkContext
    laid = written(segments(documents, sc.broadcast(block.vocabulary)), "segments")
    size = laid.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("total"), F.max("part").alias("part"), F.max("seq").alias("seq")).first()
    n, total = size["n"] or 0, size["total"] or 0
    if not n:
        return None
    df = np.zeros(len(block.vocabulary), np.int64)
    held = laid.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toPandas()  # a row per term of the block
    df[held["term"].to_numpy(np.int64)] = held["df"].to_numpy(np.int64)
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    shared = sc.broadcast((block, weights))
    stride = FAN ** max(1, math.ceil(math.log(size["seq"] + 1, FAN)))
    rows = laid.where(F.size("terms") > 0).select((F.col("part") * stride + F.col("seq")).alias("segment"), "doc_ids", "lengths", "terms", "docs", "tfs")

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment, tree in _trees(batches, shared.value[1], n, total):
            keys, values, _ = tree.levels[-1]  # the root's keys are its terms
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), segment)), pa.array(keys), pa.array(values)], names=["segment", "term", "most"])

    height = 1
    while ((size["part"] + 1) * stride - 1) >> (_SHIFT * height):
        height += 1
    leaves = rows.mapInArrow(roots, "segment long, term long, most long").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    node = F.floor(F.col("segment") / F.pow(F.lit(FAN), F.col("level"))).cast("long")
    tree = written(leaves.groupBy("level", node.alias("node"), "term").agg(F.max("most").alias("most")), "segment-tree")
    asked, floors = _probe(rows, tree, block, shared, n, total, k, height)
    found = _searched(rows, shared, n, total, k, None, floors)
    items = F.broadcast(spark.createDataFrame(pd.DataFrame({"query": np.arange(len(block.items)), "item_id": block.items})))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(items, "query").select("item_id", "rank", "doc_id", "score")


def _probe(rows: DataFrame, tree: DataFrame, block: _Block, shared, n: int, total: int, k: int, height: int) -> tuple[dict[int, list[int]], np.ndarray]:
    """Each query's descent to the segment of highest bound, and its k-th score there (0 without one)."""
    spark = rows.sparkSession
    query = np.repeat(np.arange(len(block.items)), np.diff(block.starts))
    terms = F.broadcast(spark.createDataFrame(pd.DataFrame({"query": query, "term": block.terms.astype(np.int64), "times": block.times})))
    at = pd.DataFrame({"query": np.arange(len(block.items)), "parent": 0})
    for level in range(height - 1, -1, -1):
        here = tree.where(F.col("level") == level).withColumn("parent", F.floor(F.col("node") / FAN).cast("long")).join(terms, "term").join(F.broadcast(spark.createDataFrame(at)), ["query", "parent"])
        bounds = here.groupBy("query", "node").agg(F.sum(F.col("most") * F.col("times")).alias("bound"))
        best = bounds.groupBy("query").agg(F.max(F.struct("bound", -F.col("node"))).alias("b"))
        at = best.select("query", (-F.col("b.col2")).alias("parent")).toPandas()  # a row per query of the block
        if at.empty:
            break
    asked: dict[int, list[int]] = {s: g.tolist() for s, g in at.groupby("parent")["query"]}
    floors = np.zeros(len(block.items), np.int64)
    if asked:
        wanted = F.broadcast(spark.createDataFrame([(int(s),) for s in asked], "segment long"))
        found = _searched(rows.join(wanted, "segment", "left_semi"), shared, n, total, k, asked, floors).groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).toPandas()
        floors[found["query"].to_numpy(np.int64)] = found["least"].to_numpy(np.int64)
    return asked, floors


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times) of each item's terms, in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [(i, Counter(terms_of(t))) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            rows = [(i, w, n) for i, c in counted for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.binary(), pa.int64()))], names=["item_id", "term", "times"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    return rows.mapInArrow(run, "item_id long, term binary, times long")


def top_documents(documents: DataFrame, items: DataFrame, k: int = 10, block_terms: int = QUERY_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item.

    Equal scores rank by ascending doc_id. Null and empty texts, and those without a term, have no
    documents and are no documents; nor are rows with a null doc_id. Rows that repeat a doc_id are
    documents of their own and each takes a rank. Of rows that repeat an item_id the least text is asked
    for; null ids are not. Texts may be of any length; columns other than ids and texts are ignored. An
    empty table gives an empty table. An item's terms are held whole; blocks take ``block_terms`` rows.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    asked = written(query_terms(items), "query-terms")
    blocks = max(1, math.ceil(asked.count() / block_terms))
    out = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toPandas()  # at most about block_terms rows
        found = _search_block(documents, _Block(rows), k) if len(rows) else None
        out = found if out is None else out if found is None else out.unionByName(found)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out

