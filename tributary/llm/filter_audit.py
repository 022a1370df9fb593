"""Filter interaction audit by inclusion-exclusion.

Five filters judge every document. Each of the 32 sets of filters has a joint count: how many
documents fail all of its filters, which is a sum of products of the failure flags. All that an audit
asks follows from these counts by Möbius inversion: survivors of a set of filters, what a filter
removes after others, what it alone fails, and Shapley values, where the joint count of a set, with
alternating sign, is the set's Harsanyi dividend.

Documents leave as rows of five flags that Spark adds up per part; a part is then one row of 96 counts,
and the 120 orders are worked out from that row alone.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from operator import add, mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, written

FILTERS = "ABCDE"
#: What the filters hold texts against: words, percent of distinct words, percent of capitals.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
GAP, SYMBOLS = r"[\x20\x09-\x0D]+", "[#$%&*|]"
_ALL = range(1 << len(FILTERS))
_ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: What joint counts are of: all documents, those of good quality, toxic ones.
_WEIGHTS = ("n", "n_good", "n_toxic")


def failures(documents: DataFrame) -> DataFrame:
    """(doc_id, part, A, B, C, D, E) of every row; a flag is 1 where the filter fails the text."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    split = rows.withColumn("words", F.array_remove(F.split("text", GAP, -1), ""))
    words = F.size("words")
    flagged = split.select(
        "doc_id",
        "part",
        F.unhex(F.sha2("text", 256)).alias("key"),
        (words < LEAST_WORDS).cast("int").alias("A"),
        (100 * F.size(F.array_distinct("words")) < LEAST_DISTINCT * words).cast("int").alias("B"),
        (100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > MOST_CAPITALS * F.length("text")).cast("int").alias("C"),
        F.col("text").rlike(SYMBOLS).cast("int").alias("D"),
    )
    flagged = written(flagged, "failures")
    copies = written(flagged.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("key", "first"), "copied-texts")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    return flagged.join(bounded(copies), "key", "left").select("doc_id", "part", *FILTERS[:4], later.alias("E"))


def joint_failures(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, n, n_good, n_toxic) of :func:`failures`: arrays of 32 joint counts, place s for the set of
    filters whose bits s has; place 0 counts all documents."""
    good, toxic = F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False))
    marked = labels.where(F.col("doc_id").isNotNull() & (good | toxic)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(good).cast("int").alias("good"), F.max(toxic).cast("int").alias("toxic"))
    cells = flagged.join(marked, "doc_id", "left").groupBy("part", *FILTERS, F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.count(F.lit(1)).alias("n"))

    def joint(s: int, weight: Column) -> Column:
        flags = [F.col(f) for i, f in enumerate(FILTERS) if s >> i & 1]
        return F.sum(reduce(mul, flags, weight))

    weights = dict(zip(_WEIGHTS, (F.col("n"), F.col("n") * F.col("good"), F.col("n") * F.col("toxic")), strict=True))
    return cells.groupBy("part").agg(*[F.array(*[joint(s, w) for s in _ALL]).alias(c) for c, w in weights.items()])


def survivors(counts: Column) -> Column:
    """Array of 32: documents that no filter of the set fails, by Möbius inversion of joint counts."""

    def of(p: int) -> Column:
        return reduce(add, [F.get(counts, F.lit(s)) * (-1) ** s.bit_count() for s in _ALL if s & p == s])

    return F.array(*[of(p) for p in _ALL])


def shapley(counts: Column) -> Column:
    """Array of 5: what each filter removes, summed over all 120 orders. A set shares its dividend evenly
    among its filters."""

    def of(i: int) -> Column:
        sets = [s for s in _ALL if s >> i & 1]
        return reduce(add, [F.get(counts, F.lit(s)) * ((-1) ** (s.bit_count() + 1) * len(_ORDERS) // s.bit_count()) for s in sets])

    return F.array(*[of(i) for i in range(len(FILTERS))])


def orders(joint: DataFrame) -> DataFrame:
    """The audit of each part of :func:`joint_failures`: one row per order of the filters and step."""
    known = joint.select("part", F.col("n").alias("joint"), *[survivors(F.col(w)).alias(f"{w}_left") for w in _WEIGHTS], shapley(F.col("n")).alias("shares"))
    steps = known.withColumn("filter_order", F.explode(F.array(*map(F.lit, _ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))

    def mask(letters: Column) -> Column:
        return reduce(add, [F.when(F.instr(letters, f) > 0, 1 << i).otherwise(0) for i, f in enumerate(FILTERS)])

    steps = steps.withColumn("before", mask(F.substring("filter_order", F.lit(1), F.col("step") - 1))).withColumn("own", mask(F.substring("filter_order", F.col("step"), F.lit(1))))
    before, after, everything = F.col("before"), F.col("before") + F.col("own"), F.lit(len(_ALL) - 1)

    def removed(w: str) -> Column:
        return F.get(f"{w}_left", before) - F.get(f"{w}_left", after)

    return steps.select(
        "part",
        "filter_order",
        "step",
        F.get("n_left", after).alias("kept"),
        removed("n").alias("removed"),
        (F.get("joint", F.col("own")) - removed("n")).alias("redundant"),
        (F.get("n_left", everything - F.col("own")) - F.get("n_left", everything)).alias("unique_fails"),
        removed("n_good").alias("good_lost"),
        removed("n_toxic").alias("toxic_lost"),
        F.get("shares", F.log2("own").cast("int")).alias("shapley"),
    )


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, with counts within the part.

    Parts are the values of ``source``, a null one counts as empty. A null text is an empty text; texts
    may be of any length. A row is a copy if any row of a smaller doc_id has its text, so rows that
    repeat a doc_id are no copies of each other, and a null doc_id neither makes nor is one. Rows that
    repeat count each; a doc_id that ``labels`` repeats has a mark if any of its rows has it; labels with
    nulls mark nothing. Other columns are ignored. An empty table gives an empty table, empty labels give
    zeros.
    """
    return orders(joint_failures(failures(documents), labels))
