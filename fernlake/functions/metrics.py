"""Metrics as aggregations over a frame of actual and predicted values; larger is better in all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernlake.plans.ordered import running_total

CLASSIFICATION = ("f1Macro", "f1Micro", "f1", "accuracy", "meanReciprocalRank", "hitsAtK", "rocAuc", "rocAucMicro", "rocAucMacro")
REGRESSION = ("meanSquaredError", "meanAbsoluteError", "rootMeanSquaredError", "rootMeanSquaredErrorAvg", "rSquared")
CLUSTERING = ("normalizedMutualInformation",)
#: Names used elsewhere for the same metrics, both ways.
NAMES = {
    "f1Macro": "f1_macro", "f1Micro": "f1_micro", "f1": "f1", "accuracy": "accuracy", "meanSquaredError": "mean_squared_error", "meanAbsoluteError": "mean_absolute_error",
    "rootMeanSquaredError": "root_mean_squared_error", "rootMeanSquaredErrorAvg": "root_mean_squared_error_avg", "rSquared": "r_squared", "normalizedMutualInformation": "normalized_mutual_information",
    "meanReciprocalRank": "mean_reciprocal_rank", "hitsAtK": "hits_at_k", "rocAuc": "roc_auc", "rocAucMicro": "roc_auc_micro", "rocAucMacro": "roc_auc_macro",
}
ORIGINAL = {v: k for k, v in NAMES.items()}


def translate(name: str) -> str:
    """The other name of a metric."""
    return NAMES.get(name) or ORIGINAL[name]


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """label, tp, fp, fn for each label that is actual or predicted anywhere."""
    both = df.select(F.explode(F.array(F.struct(F.col(actual).alias("label"), F.lit(1).alias("a"), (F.col(actual) == F.col(predicted)).cast("int").alias("hit")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("a"), F.lit(0).alias("hit")))).alias("x"))
    g = both.groupBy("x.label").agg(F.sum("x.a").alias("n"), F.sum("x.hit").alias("tp"), F.count_if(F.col("x.a") == 0).alias("m"))
    return g.select("label", "tp", (F.col("m") - F.col("tp")).alias("fp"), (F.col("n") - F.col("tp")).alias("fn"))


def _f1():
    d = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return F.when(d == 0, 0.0).otherwise(2.0 * F.col("tp") / d)


def f1_macro(df, actual, predicted) -> DataFrame:
    return confusion(df, actual, predicted).agg(F.avg(_f1()).alias("value"))


def f1_micro(df, actual, predicted) -> DataFrame:
    return confusion(df, actual, predicted).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")).select(_f1().alias("value"))


def f1_binary(df, actual, predicted, positive=1) -> DataFrame:
    a, p = F.col(actual) == F.lit(positive), F.col(predicted) == F.lit(positive)
    return df.agg(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn")).select(_f1().alias("value"))


def accuracy(df, actual, predicted) -> DataFrame:
    return df.agg(F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("value"))


def mean_squared_error(df, actual, predicted) -> DataFrame:
    return df.agg((-F.avg(F.pow(F.col(actual) - F.col(predicted), 2))).alias("value"))


def mean_absolute_error(df, actual, predicted) -> DataFrame:
    return df.agg((-F.avg(F.abs(F.col(actual) - F.col(predicted)))).alias("value"))


def root_mean_squared_error(df, actual, predicted) -> DataFrame:
    return df.agg((-F.sqrt(F.avg(F.pow(F.col(actual) - F.col(predicted), 2)))).alias("value"))


def r_squared(df, actual, predicted, sign: int = 1) -> DataFrame:
    """1 - residual over total squares; ``sign`` -1 negates it, for callers that minimise."""
    a = F.col(actual)
    return df.agg((F.lit(float(sign)) * (1 - F.sum(F.pow(a - F.col(predicted), 2)) / (F.var_pop(a) * F.count(a)))).alias("value"))


def normalized_mutual_information(df, actual, predicted) -> DataFrame:
    """Mutual information over the mean of both entropies; 1 where both have one value."""
    joint = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").cast("double").alias("n"))
    j = joint.withColumns({"na": F.sum("n").over(Window.partitionBy("a")), "np": F.sum("n").over(Window.partitionBy("p"))})
    total = joint.agg(F.sum("n").alias("t"))
    j = j.crossJoin(F.broadcast(total))
    n, t = F.col("n"), F.col("t")
    s = j.agg(F.sum(n / t * F.log(n * t / (F.col("na") * F.col("np")))).alias("mi"), (-F.sum(n / t * F.log(F.col("na") / t))).alias("ha"), (-F.sum(n / t * F.log(F.col("np") / t))).alias("hp"))
    return s.select(F.when(F.col("ha") + F.col("hp") == 0, 1.0).otherwise(2 * F.col("mi") / (F.col("ha") + F.col("hp"))).alias("value"))


def mean_reciprocal_rank(df, rank) -> DataFrame:
    return df.agg(F.avg(1.0 / F.col(rank)).alias("value"))


def hits_at_k(df, rank, k: int = 5) -> DataFrame:
    return df.agg(F.avg((F.col(rank) <= k).cast("double")).alias("value"))


def average_rank(df: DataFrame, value: str, to: str = "rank") -> DataFrame:
    """Ranks from 1 in rising order, equals sharing the mean of theirs.

    Distinct values are counted first, sorted by range into partitions and their counts summed there; rows are joined back by value.
    """
    counts = df.groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    ranks = running_total(counts, "__v", "__n", "__upto").select("__v", (F.col("__upto") - (F.col("__n") - 1) / F.lit(2.0)).alias(to))
    return df.join(ranks, F.col(value).eqNullSafe(F.col("__v"))).drop("__v")


def roc_auc(df, actual, score, positive=1) -> DataFrame:
    """Mann-Whitney: how often a positive scores above a negative, equals counting half; distinct scores are sorted by range into partitions."""
    y = (F.col(actual) == F.lit(positive)).cast("double")
    by = df.groupBy(F.col(score).alias("s")).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("q"))
    w = running_total(by, "s", "q", "upto").withColumn("below", F.col("upto") - F.col("q"))
    return w.agg((F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)) / (F.sum("p") * F.sum("q"))).alias("value"))


def roc_auc_macro(df, actual, scores: dict) -> DataFrame:
    """Mean of the areas of each class (value of ``actual`` -> score column) against the rest."""
    parts = [roc_auc(df, actual, c, positive=v) for v, c in scores.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.agg(F.avg("value").alias("value"))


def roc_auc_micro(df, actual, scores: dict) -> DataFrame:
    """The area over all (row, class) decisions together."""
    rows = df.select(F.explode(F.array(*[F.struct((F.col(actual) == F.lit(v)).cast("int").alias("y"), F.col(c).cast("double").alias("s")) for v, c in scores.items()])).alias("x"))
    return roc_auc(rows.select("x.y", "x.s"), "y", "s")


METRICS = {
    "f1Macro": f1_macro, "f1Micro": f1_micro, "f1": f1_binary, "accuracy": accuracy, "meanSquaredError": mean_squared_error, "meanAbsoluteError": mean_absolute_error,
    "rootMeanSquaredError": root_mean_squared_error, "rootMeanSquaredErrorAvg": root_mean_squared_error, "rSquared": r_squared, "normalizedMutualInformation": normalized_mutual_information, "rocAuc": roc_auc,
}


def evaluate(df: DataFrame, metric: str, actual: str, predicted: str) -> float:
    return METRICS[metric](df, actual, predicted).first()[0]
