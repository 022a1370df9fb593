import re
from collections import defaultdict
from itertools import permutations

from tests.llm.conftest import frame
from tributary.llm import filter_audit as A


def brute(rows, labels):
    """(part, order, step) -> counts, by walking every order over every document."""
    good, toxic = ({d for d, q, t in labels if d is not None and x(q, t)} for x in (lambda q, t: q == 1, lambda q, t: t == 1))
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    fails = []
    for d, t, s in rows:
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        f = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > least[t]}
        fails.append((s or "", {k for k, v in f.items() if v}, d in good, d in toxic))
    out = {}
    for part in {f[0] for f in fails}:
        own = [f[1:] for f in fails if f[0] == part]
        shapley = defaultdict(int)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[0]]
                left = [f for f in left if x not in f[0]]
                shapley[x] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(x in f[0] for f in own) - len(gone), sum(f[0] == {x} for f in own), sum(f[1] for f in gone), sum(f[2] for f in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def rows_of(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def marks(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_edges(spark, edge_rows, edge, nothing):
    """Nulls in every column, empty and long texts, ties, repeated rows and labels, clashing names."""
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (7, None, 1), (None, 1, 1), (9, 1, None)]
    rows = [(d, t, "s") for d, t in edge_rows] + [(d, t, None) for d, t in edge_rows] + [(3, "A " * 300, ""), (4, "Ab c " * 150 + "#", "x")]
    docs = edge.unionByName(edge.withColumn("source", A.F.lit(None).cast("string"))).unionByName(frame(spark, [(3, "A " * 300)]).withColumn("source", A.F.lit(""))).unionByName(frame(spark, [(4, "Ab c " * 150 + "#")]).withColumn("source", A.F.lit("x")))
    got = rows_of(A.audit(docs, marks(spark, labels)))
    assert got == brute(rows, labels) and len(got) == 3 * 600
    assert A.audit(nothing, marks(spark, labels)).count() == 0
    assert all(v[4:6] == [0, 0] for v in rows_of(A.audit(edge, marks(spark, []))).values())


def test_copies_in_another_part_are_copies(spark):
    docs = frame(spark, [(1, "same"), (2, "same"), (2, "same")]).withColumn("source", A.F.col("doc_id").cast("string"))
    got = rows_of(A.audit(docs, marks(spark, [])))
    assert got["1", "EABCD", 1][:2] == [1, 0] and got["2", "EABCD", 1][:2] == [0, 2]
