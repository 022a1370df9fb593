"""Connected components of a link table, by joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links(a, b)`` -> ``(node, comp)`` for every node in a link; comp is the least node reachable.

    Each round takes the least label among neighbours and then jumps to the label's own label, so
    the rounds grow with the logarithm of the longest path. Labels stay in the shared folder; the
    driver sees one count per round. Links to itself, repeated and null links do no harm; an empty
    table gives an empty table. Hot nodes aggregate map-side; their joins are left to adaptive
    skew handling.
    """
    edges = (
        links.where("a is not null and b is not null and a <> b")
        .select("a", "b")
        .unionByName(links.where("a is not null and b is not null and a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    )
    edges = written(edges, "edges")
    labels = written(
        edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp")).select("node", F.least("node", "comp").alias("comp")),
        "labels",
    )
    for _ in range(max_rounds):
        near = (
            edges.join(labels.select(F.col("node").alias("b"), "comp"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("comp").alias("near"))
        )
        lower = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
        nxt = written(lower.join(up, "comp", "left").select("node", "was", F.least("comp", "above").alias("comp")), "labels")
        moved = nxt.where("was <> comp").limit(1).count()
        labels = nxt.select("node", "comp")
        if not moved:
            return labels
    raise RuntimeError("components did not settle")
