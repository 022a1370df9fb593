"""A cascade of ten documents whose worlds and effects can be worked out by hand."""

K_C, K = 4, 2
ROWS = [
    ("a", 10, 0.10, 3, 5), ("b", 9, 0.90, 2, 3), ("c", 8, 0.50, 0, 6), ("d", 7, 0.30, 1, 8), ("e", 6, 0.95, 3, 2),
    ("f", 5, 0.20, 0, 7), ("g", 4, 0.40, 1, 4), ("h", 3, 0.05, 0, 10), ("i", 2, 0.60, 2, 1), ("j", 1, 0.15, 0, 9),
]


def cascade(spark):
    rows = [("toy1", d, float(s1), s2, alt, rel, True) for d, s1, s2, rel, alt in ROWS]
    return spark.createDataFrame(rows, "query_id string, doc_id string, s1 double, s2 double, alt_rank int, relevance long, judged boolean")
