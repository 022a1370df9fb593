"""Point metrics of a prediction against a reference, as aggregates and windows.

Rows where either side is null or NaN are left out. Correlations of fewer than three rows or of a
constant side are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import scratch

#: Rows of a group that one task may sort.
IN_ONE_TASK = 500_000


def paired(df: DataFrame, predicted: str, reference: str) -> DataFrame:
    p, r = F.col(predicted).cast("double"), F.col(reference).cast("double")
    return df.withColumns({"_p": p, "_r": r}).where("_p is not null and _r is not null and not isnan(_p) and not isnan(_r)")


def correlation(x: str, y: str):
    """Pearson correlation that is null, not an error, for constants or fewer than three rows."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(F.count(x) >= 3, F.try_divide(F.covar_pop(x, y), F.when(spread > 1e-18, spread)))


def average_rank(x: str, keys: list[str]):
    """Rank of ``x`` within ``keys``, ties sharing the mean of their ranks."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, x)) - 1) / 2.0


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared folder, for what several aggregates read."""
    place = scratch(df.sparkSession, name)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where a null key meets a null key."""
    other = right.select(*[F.col(c).alias(f"_{c}_") if c in keys else F.col(c) for c in right.columns])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}_"))
    return left.join(other, same, how).drop(*[f"_{k}_" for k in keys])


def point_metrics(df: DataFrame, predicted: str, reference: str, keys: list[str], in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """n, mae, rmse, signed_bias, pearson and spearman per ``keys``.

    Ranks are those of :func:`ranked_within`.
    """
    rows = written(paired(df, predicted, reference).select(*keys, "_p", "_r"), "paired")
    rows = ranked_within(rows, {"_pr": "_p", "_rr": "_r"}, keys, in_one_task)
    error = F.col("_p") - F.col("_r")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(error).alias("signed_bias"),
        correlation("_p", "_r").alias("pearson"), correlation("_pr", "_rr").alias("spearman"),
    )


def top_m_recovery(df: DataFrame, predicted: str, reference: str, keys: list[str], m: int, ids: list[str], by_size: bool = True) -> DataFrame:
    """Share of the m largest references that are among the m largest predictions; ties by ``ids``.

    Only heads of m rows are ranked: the planner limits each task's groups before the shuffle.
    """
    rows = paired(df, predicted, reference).select(*keys, *ids, "_p", "_r")

    def head(c: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc(F.abs(c) if by_size else F.col(c)), *ids)
        return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= m).select(*keys, *ids, F.lit(c).alias("_side"))

    met = head("_p").unionByName(head("_r")).groupBy(*keys, *ids).agg(F.count(F.lit(1)).alias("_sides"), F.max((F.col("_side") == "_r").cast("long")).alias("_wanted"))
    got = met.groupBy(*keys).agg(F.sum((F.col("_sides") == 2).cast("long")).alias("hits"), F.sum("_wanted").alias("m"))
    return got.withColumn("top_m_recovery", F.col("hits") / F.col("m"))


def cumulated(df: DataFrame, column: str, keys: list[str], ranges: int | None = None) -> DataFrame:
    """(keys, _value, _n, _upto, _total): each value of ``column`` with its number of rows, that of rows up to
    it and that of all rows of its group, for groups of any size.

    Rows are counted by value first, so a value that half of a group shares is one row from each task. The
    values are dealt out by range; a range adds up its own counts and starts from those of the ranges
    before it, so a group spans as many tasks as its values need. Counts are written, since ranges and
    totals have to see the same ones. Null values are left out, null keys are a group.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    held = written(counts.repartitionByRange(n, *keys, "_value").withColumn("_range", F.spark_partition_id()), "value-counts")
    group = Window.partitionBy(*keys)  # a row per range and group
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = held.groupBy(*keys, "_range").agg(F.sum("_n").alias("_sum"))
    sums = sums.select(*keys, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"), F.sum("_sum").over(group).alias("_total"))
    within = Window.partitionBy(*keys, "_range").orderBy("_value")
    rows = matched(held.withColumn("_upto", F.sum("_n").over(within)), sums, [*keys, "_range"])
    return rows.select(*keys, "_value", "_n", (F.col("_before") + F.col("_upto")).alias("_upto"), "_total")


def average_ranks(df: DataFrame, columns: dict[str, str], keys: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` with the average rank of each of ``columns`` (new name -> column) within ``keys``, for groups of
    any size (:func:`cumulated`). Null values have a null rank."""
    out = df
    for name, c in columns.items():
        ranked = cumulated(df, c, keys, ranges).select(*keys, F.col("_value").alias(c), (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name))
        out = matched(out, ranked.where(F.col(c).isNotNull()), [*keys, c], "left")
    return out


def ranked_within(rows: DataFrame, columns: dict[str, str], keys: list[str], in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """``rows``, which are read more than once, with the average rank of each of ``columns`` within ``keys``.

    Groups of up to ``in_one_task`` rows are ranked by windows; if the largest has more, all are ranked by
    :func:`average_ranks`, which gives the same ranks.
    """
    largest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= in_one_task:
        return rows.withColumns({name: average_rank(c, keys) for name, c in columns.items()})
    return average_ranks(rows, columns, keys)


def quantiles(df: DataFrame, column: str, shares: dict[str, float], keys: list[str], ranges: int | None = None) -> DataFrame:
    """(keys, one column per entry of ``shares``): exact quantiles of ``column``, interpolated between the two
    rows next to their place, for groups of any size (:func:`cumulated`).

    Where ``percentile`` gathers a group's distinct values in one buffer, here each range of values gives the
    one or two that a quantile falls between. Groups without a value are left out; without keys there is a row.
    """
    rows = cumulated(df, column, keys, ranges)

    def at(place: Column) -> Column:
        """The value in this place, counted from 0, of the order of the group's rows."""
        return F.max(F.when((F.col("_upto") - F.col("_n") <= place) & (place < F.col("_upto")), F.col("_value")))

    places = {name: share * (F.col("_total") - 1) for name, share in shares.items()}
    sides = [at(end(p)).alias(f"{name}_{side}") for name, p in places.items() for side, end in (("below", F.floor), ("above", F.ceil))]
    got = rows.groupBy(*keys).agg(F.max("_total").alias("_total"), *sides)
    out = []
    for name, p in places.items():
        below, above, part = F.col(f"{name}_below"), F.col(f"{name}_above"), p - F.floor(p)
        out.append(F.when(below == above, below).otherwise(below * (1 - part) + above * part).alias(name))
    return got.select(*keys, *out)


def calibration(df: DataFrame, predicted: str, reference: str, bins: int = 10) -> DataFrame:
    """Mean prediction and reference in quantile bins of the reference (right-closed, equal edges merged)."""
    rows = written(paired(df, predicted, reference).select("_p", "_r"), "paired")
    cuts = {f"e{i}": i / bins for i in range(bins + 1)}
    edges = quantiles(rows, "_r", cuts, []).select(F.array_distinct(F.array(*cuts)).alias("edges"))
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    at = F.size(F.filter(inner, lambda e: e < F.col("_r")))
    got = rows.join(F.broadcast(edges)).withColumn("bin", at)  # edges: one row
    return got.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("_r").alias("mean_reference"), F.avg("_p").alias("mean_predicted"))


def agreement(df: DataFrame, predicted: str, true: str) -> DataFrame:
    """Counts, precision, recall and F1 of a boolean label."""
    p, t = F.col(predicted), F.col(true)

    def n(c):
        return F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))

    got = df.agg(n(p & t).alias("tp"), n(p & ~t).alias("fp"), n(~p & t).alias("fn")).withColumns({"precision": F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), "recall": F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))})
    return got.withColumn("f1", F.when(F.col("tp") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))
