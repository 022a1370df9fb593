"""Does a scorer look at its batch? Pairs are scored again in other company and compared with themselves."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ListwiseScorerError


def in_batches(pairs: DataFrame, key: Sequence[str], scorer, size: int, seed: int) -> DataFrame:
    """(key, score) of ``pairs(query, text)`` in a seeded order, ``size`` pairs to a call.

    Pairs are dealt to tasks and sorted by a hash of key and seed, so another seed gives each pair other
    neighbours, in other tasks.
    """
    mixed = F.xxhash64(F.lit(seed), *key)
    dealt = pairs.withColumn("__order", mixed).repartition("__order").sortWithinPartitions("__order", *key)
    fields = [dealt.schema[c] for c in key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), size):
                part = pdf.iloc[a : a + size]
                yield part[list(key)].assign(score=scorer(part["query"].reset_index(drop=True), part["text"].reset_index(drop=True)).to_numpy(float))

    return dealt.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "score double"]))


def order_dependence(pairs: DataFrame, key: Sequence[str], scorer, seeds: Sequence[int] = (1, 2, 3), sizes: Sequence[int] = (64, 7), tolerance: float = 1e-5) -> DataFrame:
    """(key, runs, lowest, highest, depends) over one run per seed and batch size.

    A score depends on its company if it moves by more than ``tolerance``, or is a number in some runs
    only. Keys have to be unique.
    """
    if getattr(scorer, "listwise", False):
        raise ListwiseScorerError("a listwise score depends on the other documents")
    runs = reduce(DataFrame.unionByName, [in_batches(pairs, key, scorer, n, s) for s in seeds for n in sizes])
    number = F.when(~F.isnan("score"), F.col("score"))
    got = runs.groupBy(*key).agg(F.count(F.lit(1)).alias("runs"), F.count(number).alias("_numbers"), F.min(number).alias("lowest"), F.max(number).alias("highest"))
    moved = F.coalesce(F.col("highest") - F.col("lowest") > tolerance, F.lit(False))
    return got.select(*key, "runs", "lowest", "highest", (moved | ~F.col("_numbers").isin(0, len(seeds) * len(sizes))).alias("depends"))


def shuffle_invariance(pairs: DataFrame, key: Sequence[str], scorer, **options) -> DataFrame:
    """One row (n_pairs, n_dependent, largest, holds) of :func:`order_dependence`."""
    each = order_dependence(pairs, key, scorer, **options)
    n = F.coalesce(F.sum(F.col("depends").cast("long")), F.lit(0).cast("long"))
    return each.agg(F.count(F.lit(1)).alias("n_pairs"), n.alias("n_dependent"), F.max(F.col("highest") - F.col("lowest")).alias("largest"), (n == 0).alias("holds"))
