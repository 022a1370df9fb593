from collections import defaultdict

import numpy as np
import pytest

from tests.llm.conftest import frame
from tributary.llm import near_dedup as M
from tributary.llm import queries
from tributary.llm.components import components
from tributary.llm.shingles import words_of


def brute(rows, percent):
    """Least doc_id reachable over links at ``percent``, by sets of word tuples and all pairs."""
    sets = []
    for doc, text in rows:
        w = words_of(text)
        sets.append((doc, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    up = {d: d for d, _ in sets if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    held = defaultdict(list)
    for k, (d, s) in enumerate(sets):
        for x in s if d is not None else ():
            held[x].append(k)
    pairs = {(a, b) for v in held.values() for a in v for b in v if a < b}
    for a, b in pairs:
        x, y = sets[a][1], sets[b][1]
        if 100 * len(x & y) >= percent * len(x | y):
            p, q = root(sets[a][0]), root(sets[b][0])
            up[max(p, q)] = min(p, q)
    return sorted((d if d is None else d, len(s), None if d is None else root(d)) for d, s in sets if d is not None), sum(d is None for d, _ in sets)


def got(df):
    rows = df.collect()
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows if r.doc_id is not None), sum(r.doc_id is None for r in rows)


def test_against_brute_force(spark, docs, small):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(queries.op6_minhash_near_dedup(spark, small)) == brute(rows, 85)
    assert got(M.near_duplicates(docs)) == brute(rows, 80)


def test_edges(edge, edge_rows, nothing):
    out = M.near_duplicates(edge, 85)
    assert got(out) == brute(edge_rows, 85)
    rows = out.collect()
    assert all(r.kept == (r.component_id is None or r.component_id == r.doc_id) for r in rows)
    assert M.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("block", [M.BLOCK, 3000])
def test_large_groups_of_near_copies(spark, monkeypatch, block):
    """One group of edited copies, most near their source and some only near each other."""
    monkeypatch.setattr(M, "BLOCK", block)
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    rows = []
    for i in range(150):
        words = list(base)
        for p in rng.choice(120, size=int(rng.integers(0, 7)), replace=False):
            words[p] = f"e{rng.integers(0, 3 if i % 2 else 10**6)}"
        rows.append((i + 1, " ".join(words)))
    rows += [(1000 + i, " ".join(f"z{x}" for x in rng.integers(0, 5000, 60))) for i in range(20)]
    assert got(M.near_duplicates(frame(spark, rows), 85)) == brute(rows, 85)


def test_threshold_bounds_the_miss():
    from math import comb

    for percent in (80, 85, 95):
        tau = M.match_threshold(32, percent)
        p = percent / 100
        assert sum(comb(32, i) * p**i * (1 - p) ** (32 - i) for i in range(tau)) <= M.MISS


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (5, 6), (6, 5)]
    got_ = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got_ == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
