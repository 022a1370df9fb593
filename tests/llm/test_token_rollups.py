from collections import Counter

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from tributary.llm import queries
from tributary.llm import token_rollups as R
from tributary.llm.bpe import read_ranks

VERSIONS = queries.TOKENIZER_VERSIONS


def brute(rows):
    """Totals counted afresh on what the batches leave: first copies without repeated lines."""
    tool = {v: tiktoken.Encoding(v, pat_str=P.PATTERN, mergeable_ranks=dict(read_ranks(P.path(f"{v}.tiktoken"))), special_tokens={}) for v in VERSIONS}
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    docs, tokens = Counter(), Counter()
    for d, t, source, lang in rows:
        if d is None or d == least[t or ""]:
            for v in VERSIONS:
                docs[source, lang, v] += 1
                tokens[source, lang, v] += len(tool[v].encode_ordinary("\n".join(dict.fromkeys((t or "").split("\n")))))
    return {k: (docs[k], tokens[k]) for k in docs}


def got(df):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in df.collect()}


def paths():
    return [(v, P.path(f"{v}.tiktoken")) for v in VERSIONS]


def test_query(spark, docs, small):
    rows = [(r.doc_id, r.text, r.source, r.lang) for r in docs.collect()]
    assert got(queries.op2_token_rollups(spark, small)) == brute(rows)


def test_edges(edge, edge_rows, nothing):
    assert got(R.history(edge, *paths(), P.PATTERN)) == brute([(d, t, "s", "en") for d, t in edge_rows])
    unnamed = edge.withColumn("source", F.lit(None).cast("string"))
    assert {k[0] for k in got(R.history(unnamed, *paths(), P.PATTERN))} == {None}
    assert R.history(nothing, *paths(), P.PATTERN).count() == 0


def test_batches_are_idempotent(spark, tmp_path):
    book = R.Rollup(spark, str(tmp_path / "book"))
    rows = spark.createDataFrame([("a", "en", "v", 10, 12), ("a", "en", "v", 5, 5), ("b", None, "v", 3, 2)], "source string, lang string, tokenizer string, old long, new long")
    assert book.totals().count() == 0
    for _ in range(3):
        book.commit("1", R.inserts(rows, F.col("old")))
    assert got(book.totals()) == {("a", "en", "v"): (2, 15), ("b", None, "v"): (1, 3)}
    for _ in range(2):
        book.commit("2", R.revisions(rows, F.col("old"), F.col("new")))
    assert got(book.totals()) == {("a", "en", "v"): (2, 17), ("b", None, "v"): (1, 2)}
    book.commit("3", R.deletes(rows, F.col("new")))
    assert got(book.totals()) == {}
    book.commit("3", R.deletes(rows.limit(0), F.col("new")))  # the id now stands for an empty batch
    assert got(book.totals()) == {("a", "en", "v"): (2, 17), ("b", None, "v"): (1, 2)}
    assert sorted(book.batches()) == ["1", "2", "3"]
