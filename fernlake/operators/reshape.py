"""Joins, votes, samples and reshapes that learners and loaders are built of."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within_group_number(df: DataFrame, group: str, order: Iterable[str], to: str = "number") -> DataFrame:
    """Numbers from 0 within each group."""
    return df.withColumn(to, (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).cast("long"))


def equal_length(df: DataFrame, group: str, order: Iterable[str], count: str) -> DataFrame:
    """The first rows of each group, as many as the smallest group has values in ``count``."""
    least = df.groupBy(group).agg(F.count(count).alias("n")).agg(F.min("n").alias("__least"))
    numbered = within_group_number(df, group, order, "__number")
    return numbered.crossJoin(F.broadcast(least)).filter("__number < __least").drop("__number", "__least")  # one row


def majority_vote(votes: DataFrame, row: str, label: str, order: str) -> DataFrame:
    """Each row's most frequent label, the one that comes first by ``order`` of equals: (row, label, votes)."""
    n = votes.groupBy(row, label).agg(F.count("*").alias("votes"), F.min(order).alias("__first"))
    best = n.groupBy(row).agg(F.min(F.struct((-F.col("votes")).alias("n"), F.col("__first").alias("f"), F.col(label).alias("label"))).alias("b"))
    return best.select(row, F.col("b.label").alias(label), (-F.col("b.n")).alias("votes"))


def explode_confidences(df: DataFrame, keys: Iterable[str], probabilities: Column, labels: Iterable[str]) -> DataFrame:
    """A row for each row and class: keys, label, confidence."""
    names = F.array(*[F.lit(x) for x in labels])
    e = df.select(*keys, F.posexplode(probabilities).alias("__i", "confidence"))
    return e.select(*keys, F.get(names, F.col("__i")).alias("label"), "confidence")


def binary_confidence(probabilities: Column, labels: list, positive=None) -> Column:
    """Probability of the positive label, or of the second."""
    return F.get(probabilities, F.lit(labels.index(positive) if positive is not None else 1))


def prefix(df: DataFrame, share: float, order: Iterable[str]) -> DataFrame:
    """The first share of the rows in order: a prefix, not a random sample."""
    if not 0 <= share <= 1:
        raise ValueError(share)
    return df.orderBy(*order).limit(int(df.count() * share))


def hashed_sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows without replacement; the same ones however the data are partitioned."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def stratified_sample(df: DataFrame, stratum: str, most: int, key: str, seed: int = 0) -> DataFrame:
    """Up to ``most`` rows, from each stratum in proportion to its size."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("__n"))
    total = sizes.agg(F.sum("__n").alias("__all"))
    take = sizes.crossJoin(F.broadcast(total)).select(F.col(stratum).alias("__s"), F.when(F.col("__all") <= most, F.col("__n")).otherwise(F.round(F.col("__n") * F.lit(float(most)) / F.col("__all"))).alias("__take"))
    w = Window.partitionBy(stratum).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return df.withColumn("__rank", F.row_number().over(w)).join(take, F.col(stratum).eqNullSafe(F.col("__s"))).filter("__rank <= __take").drop("__rank", "__take", "__s")


def first_of_group(df: DataFrame, group: str, order: Iterable[str]) -> DataFrame:
    """The first row of each group, by aggregation and not by sorting the group."""
    rest = [c for c in df.columns if c != group]
    return df.groupBy(group).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(group, "__r.*")


def must_match(df: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Inner join in which every row has to find a partner."""
    out = df.join(table, on, "left")
    probe = [c for c in table.columns if c != on][0]
    return out.withColumn(probe, F.coalesce(probe, F.raise_error(F.concat(F.lit(f"no match for {on} "), F.col(on).cast("string"))).cast(table.schema[probe].dataType)))


def matching(df: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Only the rows that have a partner, each once."""
    return df.join(table.select(on), on, "left_semi")


def keyed_prediction(df: DataFrame, key: str, prediction: str, target: str) -> DataFrame:
    return df.select(key, F.col(prediction).alias(target))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows, by count and order-free hash of each."""
    def mark(d):
        return d.agg(F.count("*"), F.bit_xor(F.xxhash64(*d.columns)), F.sum(F.xxhash64(*d.columns).bitwiseAND(F.lit(0xFFFFFFFF)))).first()

    return a.columns == b.columns and mark(a) == mark(b)


def band_filter(df: DataFrame, band: str, order: Iterable[str]) -> DataFrame:
    """Rows of the band that the first row has."""
    first = df.agg(F.min_by(F.col(band), F.struct(*order)).alias("__b"))
    return df.crossJoin(F.broadcast(first)).filter(F.col(band) == F.col("__b")).drop("__b")


def roll_up(importances: DataFrame, sources: dict[str, str]) -> DataFrame:
    """Importances of derived columns (feature, importance) summed for the columns they stem from."""
    of = F.create_map(*[F.lit(x) for kv in sources.items() for x in kv])
    return importances.groupBy(F.coalesce(of[F.col("feature")], F.col("feature")).alias("source")).agg(F.sum("importance").alias("importance"))
