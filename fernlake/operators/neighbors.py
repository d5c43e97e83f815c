"""Nearest neighbours and diffusion on their graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernlake.functions.scalar import DISTANCES


def pair_distances(a: DataFrame, b: DataFrame, key: str, vector: str, metric: str = "sqeuclidean") -> DataFrame:
    """(query, neighbour, distance) of all pairs, by a nested loop over partitions."""
    x, y = a.select(F.col(key).alias("query"), F.col(vector).alias("__x")), b.select(F.col(key).alias("neighbour"), F.col(vector).alias("__y"))
    return x.crossJoin(y).select("query", "neighbour", DISTANCES[metric](F.col("__x"), F.col("__y")).alias("distance"))


def nearest_label(train: DataFrame, test: DataFrame, key: str, vector: str, label: str, metric: str = "sqeuclidean", block: int = 512) -> DataFrame:
    """Label of the nearest training row, the least key of equals: (key, label, neighbour, distance).

    Training rows are packed into blocks, every query row meets every block, and a block's distances are one matrix product in an Arrow batch; the
    least of each block is kept before the least of all, so what is shuffled are queries times blocks.
    """
    if metric not in ("sqeuclidean", "euclidean"):
        d = pair_distances(test, train, key, vector, metric).join(train.select(F.col(key).alias("neighbour"), F.col(label).alias("label")), "neighbour")
        best = d.groupBy("query").agg(F.min(F.struct("distance", "neighbour", "label")).alias("b"))
        return best.select(F.col("query").alias(key), F.col("b.label").alias("label"), F.col("b.neighbour").alias("neighbour"), F.col("b.distance").alias("distance"))
    import numpy as np
    import pandas as pd

    kind = train.schema[label].dataType.simpleString()
    packed = train.select(F.pmod(F.xxhash64(key), F.lit(max(1, -(-train.count() // block)))).alias("__block"), key, label, F.col(vector).cast("array<double>").alias("v"))
    packed = packed.groupBy("__block").agg(F.collect_list(key).alias("keys"), F.collect_list(label).alias("labels"), F.collect_list("v").alias("vs"))
    queries = test.select(key, F.col(vector).cast("array<double>").alias("v"))
    queries = queries.withColumn("__part", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(max(1, -(-test.count() // 4096)))))
    queries = queries.groupBy("__part").agg(F.collect_list(key).alias("qk"), F.collect_list("v").alias("qv"))

    def run(batches):
        for b in batches:
            for ks, ls, vs, qk, qv in zip(b["keys"], b["labels"], b["vs"], b["qk"], b["qv"]):
                y, x = np.array(vs.tolist()), np.array(qv.tolist())
                ks = np.array(ks)
                o = np.argsort(ks, kind="stable")
                ks, ls, y = ks[o], np.array(ls)[o], y[o]
                rough = (x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1)
                close = rough <= rough.min(axis=1, keepdims=True) + 1e-7 * (1 + np.abs(rough).max())
                at, d = np.empty(len(x), int), np.empty(len(x))
                for i in range(len(x)):  # exact distances decide among those the product can't tell apart
                    c = np.flatnonzero(close[i])
                    e = ((x[i] - y[c]) ** 2).sum(1)
                    at[i], d[i] = c[e.argmin()], e.min()
                yield pd.DataFrame({"query": qk, "label": ls[at], "neighbour": ks[at], "distance": d})

    found = queries.crossJoin(packed).mapInPandas(run, f"query long, label {kind}, neighbour long, distance double")
    best = found.groupBy("query").agg(F.min(F.struct("distance", "neighbour", "label")).alias("b"))
    distance = F.col("b.distance") if metric == "sqeuclidean" else F.sqrt("b.distance")
    return best.select(F.col("query").alias(key), F.col("b.label").alias("label"), F.col("b.neighbour").alias("neighbour"), distance.alias("distance"))


def top_similar(sims: DataFrame, row: str, other: str, sim: str, k: int = 16) -> DataFrame:
    """Entries of each row at least as large as its k-th; equals of the k-th stay."""
    w = Window.partitionBy(row).orderBy(F.desc(sim))
    return sims.withColumn("__r", F.rank().over(w)).filter(F.col("__r") <= k).drop("__r").filter(F.col(row) != F.col(other))


def diffuse(graph: DataFrame, start: DataFrame, alpha: float = 0.9, terms: int = 20) -> DataFrame:
    """sum alpha^t A^t applied to (id, label, value), by joins; A is a normalised symmetric graph (src, dst, w)."""
    total = now = start
    for t in range(terms):
        now = graph.join(now, graph["dst"] == now["id"]).groupBy(F.col("src").alias("id"), "label").agg((F.lit(alpha) * F.sum(F.col("w") * F.col("value"))).alias("value"))
        if t % 5 == 4:
            from fernlake.plans.lineage import cut

            now = cut(now)
        total = total.unionByName(now).groupBy("id", "label").agg(F.sum("value").alias("value"))
    return total


def dtw(a: list[float], b: list[float]) -> float:
    """Dynamic time warping distance of two series."""
    import numpy as np

    row = np.full(len(b) + 1, np.inf)
    row[0] = 0
    for x in a:
        new = np.full(len(b) + 1, np.inf)
        for j, y in enumerate(b, 1):
            new[j] = abs(x - y) + min(row[j], row[j - 1], new[j - 1])
        row = new
    return float(row[-1])


def dtw_column():
    import pandas as pd

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([dtw(x, y) for x, y in zip(a, b)])

    return distance
