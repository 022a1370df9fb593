"""Putting tables of several owners together: every row that is lost, doubled or unasked gets its reason.

All tables meet in one grouped pass over (query_id, doc_id), whatever their number. A pair is as it
should be if each required table has it once and no table has it that the universe lacks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InputError

KEY = ["query_id", "doc_id"]
LOST, DOUBLED, UNASKED, NO_KEY = "lost", "doubled", "unasked", "no_key"


def reasons(universe: DataFrame, tables: dict[str, DataFrame], required: list[str]) -> DataFrame:
    """(query_id, doc_id, source, reason) of every pair and table that do not fit.

    ``lost``: a required table lacks a pair of the universe; ``doubled``: a table, or the universe itself,
    has it more than once; ``unasked``: the universe lacks it; ``no_key``: an id is null. Nothing else is
    reported of a pair without a key.
    """
    if unknown := set(required) - set(tables):
        raise InputError(f"no table {sorted(unknown)}")
    sides = {"universe": universe, **tables}
    tagged = reduce(DataFrame.unionByName, [df.select(*KEY, F.lit(name).alias("source")) for name, df in sides.items()])
    counts = tagged.groupBy(*KEY).agg(*[F.sum((F.col("source") == name).cast("long")).alias(f"n_{i}") for i, name in enumerate(sides)])
    whole = F.col("query_id").isNotNull() & F.col("doc_id").isNotNull()
    found = []
    for i, name in enumerate(sides):
        n, asked = F.col(f"n_{i}"), F.col("n_0") > 0
        rules = [(~whole & (n > 0), NO_KEY), (whole & (n > 1), DOUBLED)]
        if i:
            rules.append((whole & (n > 0) & ~asked, UNASKED))
            if name in required:
                rules.append((whole & (n == 0) & asked, LOST))
        found += [F.when(holds, F.struct(F.lit(name).alias("source"), F.lit(why).alias("reason"))) for holds, why in rules]
    return counts.select(*KEY, F.explode(F.array_compact(F.array(*found))).alias("r")).select(*KEY, "r.source", "r.reason")


def summary(found: DataFrame) -> DataFrame:
    """(source, reason, pairs, queries) of :func:`reasons`."""
    per = found.groupBy("source", "reason", "query_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("source", "reason").agg(F.sum("n").alias("pairs"), F.count(F.lit(1)).alias("queries"))


def require_fit(universe: DataFrame, tables: dict[str, DataFrame], required: list[str]) -> None:
    """Refuse tables that do not fit together, with the reasons and an example of each."""
    found = reasons(universe, tables, required)
    bad = found.groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEY)).alias("first")).orderBy("source", "reason").collect()
    if bad:
        raise InputError("; ".join(f"{r.n} pairs {r.reason} in {r.source}, such as ({r['first'].query_id}, {r['first'].doc_id})" for r in bad))
