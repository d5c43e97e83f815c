"""Sums and numbers in a global order, without bringing all rows into one task."""

from __future__ import annotations

from itertools import accumulate
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernlake.plans.lineage import cut


def ranged(df: DataFrame, order: str) -> DataFrame:
    """The rows sorted by range into partitions, with their partition's number ``__p``.

    They are written to the checkpoint folder: bounds are sampled anew whenever such a plan runs, so what is counted for each partition holds for one run only.
    """
    return cut(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id()))


def offsets(parts: DataFrame, size: Column, start=0) -> Column | None:
    """For a row of ``ranged`` what the partitions before its own add up to; None where there are no rows. One number for each partition is collected."""
    before, at = [], start
    for p, n in sorted(tuple(r) for r in parts.groupBy("__p").agg(size).collect()):
        before += [F.lit(p), F.lit(at)]
        at += n
    return F.create_map(*before)[F.col("__p")] if before else None


def running_total(df: DataFrame, order: str, value: str, to: str) -> DataFrame:
    """The rows with the sum of ``value`` over all rows up to theirs; ``order`` has no ties."""
    parts = ranged(df, order)
    before = offsets(parts, F.sum(value))
    if before is None:
        return df.withColumn(to, F.col(value)).limit(0)
    own = F.sum(value).over(Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn(to, before + own).drop("__p")


def quantiles(df: DataFrame, value: Column, at: list[float]) -> list[float | None]:
    """The exact quantiles of a number, interpolated between the two nearest values as by ``percentile``; nulls don't count, without values all are None.

    Distinct values are counted first and sorted by range into partitions; only those partitions that hold a wanted place are gone through.
    """
    counts = df.select(value.cast("double").alias("__v")).filter("__v is not null").groupBy("__v").agg(F.count("*").alias("__n"))
    parts = ranged(counts, "__v")
    sizes = sorted(tuple(r) for r in parts.groupBy("__p").agg(F.sum("__n")).collect())
    if not sizes:
        return [None] * len(at)
    ends = list(accumulate(n for _, n in sizes))
    places = [q * (ends[-1] - 1) for q in at]
    wanted = sorted({f(x) for x in places for f in (floor, ceil)})
    before = [(p, end - n) for (p, n), end in zip(sizes, ends) if any(end - n <= r < end for r in wanted)]
    upto = F.create_map(*[F.lit(x) for b in before for x in b])[F.col("__p")] + F.sum("__n").over(Window.partitionBy("__p").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    some = parts.filter(F.col("__p").isin([p for p, _ in before])).withColumn("__upto", upto)
    holds = F.exists(F.array(*[F.lit(r) for r in wanted]), lambda r: (r < F.col("__upto")) & (r >= F.col("__upto") - F.col("__n")))
    rows = some.filter(holds).select("__v", "__n", "__upto").collect()
    of = {r: v for v, n, end in rows for r in wanted if end - n <= r < end}
    return [of[floor(x)] if of[floor(x)] == of[ceil(x)] else (ceil(x) - x) * of[floor(x)] + (x - floor(x)) * of[ceil(x)] for x in places]
