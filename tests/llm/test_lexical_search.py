import math
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import frame
from tributary.llm import lexical_search as L


def terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items, k=10):
    """Every document scored for every item."""
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs if d is not None and terms(t)]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(w for _, c, _ in held for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for w, x in df.items()}
    out, least = [], {}
    for i, t in items:
        if i is not None and t is not None:
            least[i] = min(t, least.get(i, t))
    for i, t in least.items():
        scored = []
        for d, c, size in held:
            m = 100 - 75 + (75 * size * n) // total
            if (s := sum(times * weight[w] * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w, times in Counter(terms(t)).items() if w in c)) > 0:
                scored.append((-s, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def found(df):
    return sorted((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect())


def asked(spark, rows):
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "item_id long, text string, score int")


ITEMS = [(1, "Line number 7 of a TEXT that repeats"), (2, "word3 word3 word5"), (3, None), (4, ""), (5, "?!"), (None, "line"), (6, "été 中文"), (7, "absent everywhere"), (8, "short one"), (8, "zzz")]


@pytest.mark.parametrize("docs_in, fan", [(4096, 16), (2, 2)])
def test_edges(spark, edge, edge_rows, nothing, monkeypatch, docs_in, fan):
    monkeypatch.setattr(L, "SEGMENT_DOCS", docs_in)
    monkeypatch.setattr(L, "FAN", fan)
    monkeypatch.setattr(L, "_SHIFT", fan.bit_length() - 1)
    got = L.top_documents(edge, asked(spark, ITEMS), k=3)
    assert found(got) == brute(edge_rows, ITEMS, 3)
    assert L.top_documents(nothing, asked(spark, ITEMS)).count() == 0 and L.top_documents(edge, asked(spark, [])).count() == 0


def test_blocks_of_queries_give_the_same(spark, docs, small):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found(L.top_documents(docs, items)) == found(L.top_documents(docs, items, block_terms=60)) == want


def tree(rng, n=4096):
    """A segment in which a few documents have all terms and each term's other documents lie together."""
    rows = {(t, d) for t in range(12) for d in range(t * 300, t * 300 + 250)} | {(t, d) for d in (40, 2000, 3999) for t in range(12)}
    term, doc = (np.array(x, np.int32) for x in zip(*sorted(rows), strict=True))
    return L.Tree(np.arange(n), np.full(n, 50), term, doc, rng.integers(1, 4, len(term)), np.arange(100, 112), n, 50 * n), term, doc


def test_branches_below_the_bound_stay_closed():
    rng = np.random.default_rng(1)
    made, term, doc = tree(rng)
    terms_, times = np.arange(12), np.ones(12, np.int64)
    best: list = []
    opened = made.search(terms_, times, int(made.root(12).sum()), 0, 3, best)
    nodes = 1 + 16 + 256
    scores = np.zeros(4096, np.int64)
    np.add.at(scores, doc, made.levels[0][1])
    assert sorted(best, reverse=True) == sorted(((int(s), -d) for d, s in enumerate(scores)), reverse=True)[:3]
    assert opened < nodes // 10


def test_ties_open_equal_bounds():
    """All documents score the same: the least ids win, though the highest ids come first."""
    n = 300
    made = L.Tree(np.arange(n)[::-1], np.full(n, 5), np.zeros(n, np.int32), np.arange(n, dtype=np.int32), np.ones(n, np.int64), np.array([7]), n, 5 * n)
    best: list = []
    made.search(np.array([0]), np.array([1]), int(made.root(1)[0]), 0, 10, best)
    assert sorted(-d for _, d in best) == list(range(10))
