"""How many partitions an input takes."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of input for each partition.
PART_BYTES = 8_000_000


def parts_of(df: DataFrame, each: int = PART_BYTES) -> int | None:
    """Partitions in proportion to the sizes of what the plan reads, so that a task's share doesn't grow with the input; None where a size isn't known."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    unknown = int(df.sparkSession.conf.get("spark.sql.defaultSizeInBytes", str(2**63 - 1)).rstrip("bB"))
    return None if max(sizes, default=0) >= unknown else max(1, -(-sum(sizes) // each))


def spread(df: DataFrame, *by: str, like: DataFrame | None = None) -> DataFrame:
    """The rows partitioned by columns, into as many parts as the input of ``like`` (by default their own) takes; unchanged where that isn't known."""
    n = parts_of(df if like is None else like)
    return df if n is None else df.repartition(n, *by)


def distinct(df: DataFrame) -> DataFrame:
    """Distinct rows, in parts that don't grow with the input. Rows travel before any are compared, so no task holds those of a larger share in a map."""
    return spread(df, *df.columns).distinct()
