"""Graphs as tables of nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernlake.plans.lineage import written
from fernlake.plans.parts import distinct


def nodes_of(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return edges.select(F.col(src).alias("id")).union(edges.select(dst)).distinct()


def symmetrize(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct edges of both directions. Either direction of an edge is the same pair, so each pair travels and is held once, and is turned round afterwards."""
    pair = F.sort_array(F.array(src, dst))
    pairs = distinct(edges.select(F.get(pair, F.lit(0)).alias("__low"), F.get(pair, F.lit(1)).alias("__high")))
    both = F.array(F.struct(F.col("__low").alias(src), F.col("__high").alias(dst)), F.struct(F.col("__high").alias(src), F.col("__low").alias(dst)))
    return pairs.select(F.inline(F.when(F.col("__low").eqNullSafe(F.col("__high")), F.slice(both, 1, 1)).otherwise(both)))


def adjacency(edges: DataFrame, src: str = "src", dst: str = "dst", kind: str | None = None) -> DataFrame:
    """Entries of the (sparse) adjacency matrix, or tensor with ``kind``: how many edges each place has."""
    by = [src, dst, *([kind] if kind else [])]
    return edges.groupBy(*by).agg(F.count("*").alias("n"))


def normalize(edges: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = None) -> DataFrame:
    """src, dst, w divided by the root of both ends' degrees; a degree of 0 counts as 1e-6."""
    e = edges.select(src, dst, (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    d = e.groupBy(src).agg(F.sum("w").alias("d")).withColumn("d", F.when(F.col("d") == 0, 1e-6).otherwise(F.col("d")))
    out = e.join(d.withColumnRenamed("d", "__ds"), src).join(d.toDF(dst, "__dd"), dst, "left")
    return out.select(src, dst, (F.col("w") / F.sqrt(F.col("__ds") * F.coalesce("__dd", F.lit(1e-6)))).alias("w"))


def attach(nodes: DataFrame, attributes: DataFrame, on: str = "id") -> DataFrame:
    """Nodes with their attributes, 0 where there are none."""
    out = nodes.join(attributes, on, "left")
    return out.na.fill(0, [c for c in attributes.columns if c != on])


def edge_difference(candidates: DataFrame, edges: DataFrame, on: list[str]) -> DataFrame:
    """Candidates that aren't edges."""
    return candidates.join(edges.select(*on).distinct(), on, "left_anti")


def negative_sample(nodes: DataFrame, kinds: DataFrame, edges: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n random (src, dst, kind) that aren't edges, by hash of a number, the same in every run; all of them where there are no more than n.

    Sparse graphs are drawn from, anew with more draws where too many hit edges; where draws would come near to the number of places, all places are gone through.
    Draws are written, so that as few as there mostly are go to where nodes and edges lie, which are gone through once for each number of draws.
    """
    from fernlake.operators.encode import numbered

    ids, ks = numbered(nodes.select("id"), "id", "__i"), numbered(kinds.select("kind"), "kind", "__k")
    many, types = ids.count(), ks.count()
    if not many or not types:
        return edges.select("src", "dst", "kind").limit(0)
    on, size = ["src", "dst", "kind"], 4 * n
    while True:
        every = size >= many * many * types // 4
        span = nodes.sparkSession.range(many * many * types if every else size)
        if every:
            places = [F.floor(F.col("id") / (many * types)), F.floor(F.col("id") / types) % many, F.col("id") % types]
        else:
            places = [F.pmod(F.xxhash64("id", F.lit(seed + s)), F.lit(m)) for s, m in ((1, many), (2, many), (3, types))]
        draws = written(span.select(*[p.cast("long").alias(c) for p, c in zip(places, ("__a", "__b", "__c"))], (F.xxhash64("id", F.lit(seed)) if every else F.col("id")).alias("__draw")))
        named = written(ids.join(draws.select(F.col("__a").alias("__i")).union(draws.select("__b")).distinct(), "__i", "left_semi").select("id", "__i"))
        out = draws.join(named.toDF("src", "__a"), "__a").join(named.toDF("dst", "__b"), "__b").join(ks.toDF("kind", "__c"), "__c")
        out = written(out.groupBy(*on).agg(F.min("__draw").alias("__draw")))
        out = written(edge_difference(out, edges.join(out, on, "left_semi"), on).orderBy("__draw").limit(n).drop("__draw"))
        if every or out.count() >= n:
            return out
        size *= 4


def normalize_kinds(scores: DataFrame) -> DataFrame:
    """src, dst, kind, score: each pair's scores divided by their Euclidean norm over the kinds of link."""
    of = Window.partitionBy("src", "dst")
    return scores.withColumn("score", F.col("score") / (F.sqrt(F.sum(F.col("score") * F.col("score")).over(of)) + F.lit(1e-10)))


def gather(scores: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted (src, dst, kind) with their scores, 0 where there is none."""
    on = ["src", "dst", "kind"]
    return wanted.join(scores.select(*on, "score"), on, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


class LinkPrediction:
    """Whether edges of a kind exist: non-negative factors for each kind of link, scores normalised over the kinds, and a threshold.

    The threshold is the mean of the best ones of ``folds`` folds, each with as many places that aren't edges as it has edges. Kinds are few: each
    has factors of its own, and a job of its own to find them.
    """

    def __init__(self, rank: int = 10, steps: int = 8, folds: int = 10, seed: int = 0, thresholds: int = 512):
        self.rank, self.steps, self.folds, self.seed, self.thresholds = rank, steps, folds, seed, thresholds
        self.models, self.threshold = {}, None

    def _factors(self, edges: DataFrame) -> dict:
        kinds = sorted(r[0] for r in edges.select("kind").distinct().collect())
        return {k: factorize_links(edges.filter(F.col("kind") == F.lit(k)), self.rank, self.steps, self.seed) for k in kinds}

    def _scores(self, models: dict, wanted: DataFrame) -> DataFrame:
        pairs, out = wanted.select("src", "dst").distinct(), None
        for k, (model, ids) in models.items():
            own = score_links(model, ids, pairs).withColumn("kind", F.lit(k))
            out = own if out is None else out.unionByName(own)
        return gather(normalize_kinds(out), wanted)

    def fit(self, edges: DataFrame) -> LinkPrediction:
        from fernlake.plans.lineage import cut

        e = cut(edges.select("src", "dst", "kind").distinct().withColumn("__fold", F.pmod(F.xxhash64("src", "dst", "kind", F.lit(self.seed)), F.lit(self.folds))))
        nodes, found = nodes_of(e), []
        for f in range(self.folds):
            here = e.filter(F.col("__fold") == f).drop("__fold")
            n = here.count()
            if not n:
                continue
            none = negative_sample(nodes, e.select("kind"), e, n, self.seed + 17 * f)
            valid = here.withColumn("y", F.lit(True)).unionByName(none.withColumn("y", F.lit(False)))
            scored = self._scores(self._factors(e.filter(F.col("__fold") != f)), valid)
            found.append(best_threshold(scored, "score", "y", self.thresholds).first()["threshold"])
        self.threshold = sum(found) / len(found) if found else 0.0
        self.models = self._factors(e)
        return self

    def predict(self, wanted: DataFrame) -> DataFrame:
        """The wanted (src, dst, kind) with ``score`` and ``linked``; kinds and nodes never seen have no link."""
        return self._scores(self.models, wanted).withColumn("linked", F.col("score") > F.lit(self.threshold))

    def get_params(self) -> dict:
        return dict(vars(self))

    def set_params(self, params: dict) -> LinkPrediction:
        vars(self).update(params)
        return self


def community_null(df: DataFrame, key: str, target: str = "community") -> DataFrame:
    """The null model: every row a community of its own, numbered 0, -1, -2, ... by key."""
    from fernlake.operators.encode import numbered

    return numbered(df, key, target).withColumn(target, -F.col(target))


def pad_nodes(a: DataFrame, b: DataFrame, prefix: str = "__pad_") -> tuple[DataFrame, DataFrame]:
    """Both node tables with as many rows, by isolated nodes."""
    na, nb = a.count(), b.count()
    new = lambda n, m: a.sparkSession.range(n, m).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("id"))
    return (a.union(new(na, nb)) if na < nb else a), (b.union(new(nb, na)) if nb < na else b)


def best_threshold(scores: DataFrame, score: str, actual: str, n: int = 512, low: float = -1.0, high: float = 1.0, fold: str | None = None) -> DataFrame:
    """The threshold of ``n`` even ones with the highest accuracy, the least of equals; with ``fold``, one for each.

    A row's place among the thresholds is computed, not joined: counts for each place are summed up in order.
    """
    step = (high - low) / (n - 1)
    place = F.greatest(F.least(F.ceil((F.col(score) - low) / step), F.lit(n)), F.lit(0))  # predicted positive for thresholds with index < place
    f = F.col(fold) if fold else F.lit(0)
    by = scores.groupBy(f.alias("fold"), place.cast("int").alias("place")).agg(F.count_if(F.col(actual)).alias("p"), F.count_if(~F.col(actual)).alias("q"))
    w = Window.partitionBy("fold").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    grid = by.select("fold").distinct().crossJoin(scores.sparkSession.range(n).select(F.col("id").cast("int").alias("i")))
    g = grid.join(by, (grid["fold"] == by["fold"]) & (grid["i"] == by["place"]), "left").select(grid["fold"], "i", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("q", F.lit(0)).alias("q"))
    totals = by.groupBy("fold").agg(F.sum("p").alias("all_p"))
    g = g.join(totals, "fold").withColumn("right", F.col("all_p") - F.sum("p").over(w) + F.sum("q").over(w))
    best = g.groupBy("fold").agg(F.max(F.struct("right", (-F.col("i")).alias("m"))).alias("b"))
    out = best.select("fold", (F.lit(low) + (-F.col("b.m")) * F.lit(step)).alias("threshold"), F.col("b.right").alias("right"))
    return out if fold else out.drop("fold")


def factorize_links(edges: DataFrame, rank: int = 10, steps: int = 8, seed: int = 0):
    """Non-negative factors of the adjacency by alternating least squares: (model, numbered ids). Scores are products of factors."""
    from pyspark.ml.recommendation import ALS

    from fernlake.operators.encode import numbered

    ids = numbered(nodes_of(edges), "id", "n")
    e = edges.join(ids.toDF("src", "__s"), "src").join(ids.toDF("dst", "__d"), "dst").groupBy("__s", "__d").agg(F.count("*").cast("float").alias("w"))
    e = e.withColumns({"__s": F.col("__s").cast("int"), "__d": F.col("__d").cast("int")})
    return ALS(rank=rank, maxIter=steps, seed=seed, nonnegative=True, implicitPrefs=True, userCol="__s", itemCol="__d", ratingCol="w", coldStartStrategy="nan").fit(e), ids


def score_links(model, ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (src, dst) with a score, 0 where an end is unknown."""
    p = pairs.join(ids.toDF("src", "__s"), "src", "left").join(ids.toDF("dst", "__d"), "dst", "left")
    p = p.withColumns({"__s": F.coalesce("__s", F.lit(-1)).cast("int"), "__d": F.coalesce("__d", F.lit(-1)).cast("int")})
    return model.transform(p).select("src", "dst", F.when(F.isnan("prediction"), 0.0).otherwise(F.coalesce(F.col("prediction").cast("double"), F.lit(0.0))).alias("score"))


def spectral(edges: DataFrame, k: int = 8):
    """Left singular vectors of the adjacency, a row for each node: (id, v array). Missing rows are nodes without edges."""
    from pyspark.mllib.linalg.distributed import CoordinateMatrix, MatrixEntry

    from fernlake.operators.encode import numbered

    ids = numbered(nodes_of(edges), "id", "n")
    n = ids.count()
    e = edges.join(ids.toDF("src", "__s"), "src").join(ids.toDF("dst", "__d"), "dst").groupBy("__s", "__d").agg(F.count("*").alias("w"))
    svd = CoordinateMatrix(e.rdd.map(lambda r: MatrixEntry(r[0], r[1], float(r[2]))), n, n).toIndexedRowMatrix().computeSVD(min(k, n), computeU=True)
    u = svd.U.rows.map(lambda r: (int(r.index), [float(x) for x in r.vector])).toDF("n long, v array<double>")
    return ids.join(u, "n").select("id", "v")


def match_seeded(a, b, seeds: list[tuple[int, int]], steps: int = 20):
    """Seeded graph matching of two small adjacency matrices by Frank-Wolfe; returns for each node of a its node of b.

    The matrices are dense and on the driver: matching is cubic in the nodes and has no distributed form here.
    """
    import numpy as np

    n = len(a)
    rest_a = [i for i in range(n) if i not in {s for s, _ in seeds}]
    rest_b = [j for j in range(n) if j not in {t for _, t in seeds}]
    sa, sb, m = [s for s, _ in seeds], [t for _, t in seeds], len(rest_a)
    p = np.full((m, m), 1 / max(m, 1))
    a22, b22 = a[np.ix_(rest_a, rest_a)], b[np.ix_(rest_b, rest_b)]
    fixed = a[np.ix_(rest_a, sa)] @ b[np.ix_(rest_b, sb)].T + a[np.ix_(sa, rest_a)].T @ b[np.ix_(sb, rest_b)]
    for _ in range(steps if m else 0):
        grad = fixed + a22 @ p @ b22.T + a22.T @ p @ b22
        q = np.zeros((m, m))
        q[np.arange(m), assign(-grad)] = 1
        d = q - p
        c2 = float((a22 @ d @ b22.T * d).sum())
        c1 = float((grad * d).sum())
        step = 1.0 if c2 >= 0 else min(1.0, -c1 / (2 * c2))
        if abs(c1) < 1e-9:
            break
        p = p + step * d
    out = np.zeros(n, int)
    out[sa] = sb
    if m:
        out[rest_a] = np.array(rest_b)[assign(-p)]
    return out


def assign(cost):
    """Cheapest one-to-one assignment of rows to columns (shortest augmenting paths)."""
    import numpy as np

    n = len(cost)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, way, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            reduced = cost[match[j0] - 1] - u[match[j0]] - v[1:]
            better = ~used[1:] & (reduced < low[1:])
            low[1:][better], way[1:][better] = reduced[better], j0
            free = np.where(used[1:], np.inf, low[1:])
            j1 = int(free.argmin()) + 1
            delta = free[j1 - 1]
            u[match[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = np.zeros(n, int)
    for j in range(1, n + 1):
        out[match[j] - 1] = j - 1
    return out
