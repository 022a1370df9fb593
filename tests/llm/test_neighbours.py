import numpy as np
import pytest

from tributary.llm import neighbours as A
from tributary.llm import queries


def brute(rows, every=20, k=20):
    rows = sorted({(i, tuple(v)) for i, v in rows})
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for q in range(len(ids)):
        if ids[q] % every == 0:
            score = (x * x[q]).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[q]][:k]
            out[int(ids[q])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in want[q]} & {i for i, _ in got.get(q, ())}) / max(1, len(want[q])) for q in want])


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_recall(spark, folder):
    want = brute([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()])
    got = found(queries.op9_projected_neighbours(spark, folder))
    assert set(got) == set(want) and recall(got, want) > 0.95
    for q in got:
        exact = dict(want[q])
        assert all(s == pytest.approx(exact[i], abs=1e-9) for i, s in got[q] if i in exact)


def test_cells_and_chunks(spark, monkeypatch):
    for name, value in (("CELL", 100), ("CHUNK", 60), ("BLOCK", 5), ("LEAF", 8)):
        monkeypatch.setattr(A, name, value)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.2 * rng.normal(size=16)).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert recall(found(A.nearest(df, every=10, k=10)), brute(rows, 10, 10)) > 0.95


def test_edges(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(0, 120)] + [(200, [3.0, 2.0, 1.0]), (201, [0.5, 0.5, 0.5]), (201, [0.5, 0.5, 0.5])]
    bad = [(300, None), (301, [0.0, 0.0, 0.0]), (302, [1.0, None, 2.0]), (303, [float("nan"), 1.0, 1.0]), (304, [float("inf"), 1.0, 1.0]), (320, [1.0, 2.0]), (340, []), (None, same)]
    df = spark.createDataFrame([(i, v, "c", 1) for i, v in rows + bad], "vec_id long, embedding array<double>, cell string, x int").repartition(3)
    got, want = found(A.nearest(df)), brute(rows)
    assert set(got) == set(want)
    for q in want:  # ties go to the smaller id, the query's own is left out
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.rank) for r in A.nearest(few).orderBy("rank").collect()] == [(2, 1), (1, 2)]
    assert A.nearest(few.limit(0)).count() == 0 and A.nearest(few.where("vec_id = 0")).count() == 0


def test_chi_square():
    x = np.random.default_rng(0).normal(size=(200_000, A.PROJECTED))
    for p in (0.5, 0.9, 0.985):
        assert np.mean((x**2).sum(axis=1) <= A.quantile(p)) == pytest.approx(p, abs=0.005)


def pruned(x, every=20, k=20):
    """Share of pairs verified by the search of one chunk, and its recall."""
    ids = np.arange(len(x))
    asked = ids % every == 0
    longest = float((x * x).sum(axis=1).max())
    got, verified = A.search(ids, x, ids[asked], x[asked], np.full(asked.sum(), -1e300), A.weights(x.shape[1]), longest, k)
    want = brute([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], every, k)
    by_query = {}
    for q, i, s in got:
        by_query.setdefault(q, []).append((i, s))
    return verified / (asked.sum() * (len(x) - 1)), recall(by_query, want)


def test_search_verifies_few_vectors_of_clusters_and_not_all_others():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 64))
    x = centres[rng.integers(0, 40, 4000)] + 0.3 * rng.normal(size=(4000, 64))
    share, found_share = pruned(x / np.linalg.norm(x, axis=1)[:, None])
    assert share < 0.2 and found_share > 0.9
    x = rng.normal(size=(4000, 64))  # no direction is denser than another
    share, found_share = pruned(x / np.linalg.norm(x, axis=1)[:, None])
    assert share < 0.9 and found_share > 0.9
