"""Learners, as thin layers over Spark ML: forests, linear classifiers, clusters, recommenders, baselines."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernlake import metadata as M
from fernlake.functions.metrics import CLASSIFICATION, METRICS, REGRESSION
from fernlake.operators import clean, encode, reshape
from fernlake.plans.ordered import quantiles


def assemble(df: DataFrame, features: Iterable[str], to: str = "__features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(features), outputCol=to, handleInvalid="keep").transform(df)


@dataclass
class Learner:
    """What supervised learners share: features, labels as codes in order of first appearance, parameters that can be taken out and put back."""

    metric: str = "f1Macro"
    seed: int = 0
    features: list[str] = field(default_factory=list)
    labels: list | None = None
    details: dict = field(default_factory=dict)

    @property
    def classifies(self) -> bool:
        return self.metric not in REGRESSION

    def prepare(self, df: DataFrame, target: str, key: str, features: Iterable[str] | None) -> DataFrame:
        self.features = list(features) if features is not None else [c for c in M.numeric_only(df).columns if c not in (target, key)]
        df = clean.drop_incomplete(df, target, self.features)
        if not self.classifies:
            return assemble(df.withColumn("__label", F.col(target).cast("double")), self.features)
        codes = encode.factorize(df, target, key)
        self.labels = [r[0] for r in codes.orderBy("code").collect()]  # one row for each class
        return assemble(df.join(F.broadcast(codes), F.col(target) == F.col("value")).withColumn("__label", F.col("code").cast("double")).drop("value", "code"), self.features)

    def name_of(self, code):
        return F.get(F.array(*[F.lit(x) for x in self.labels]), code.cast("int"))

    def get_params(self) -> dict:
        return dict(vars(self))

    def set_params(self, params: dict):
        vars(self).update(params)
        return self


@dataclass
class Forest(Learner):
    """One or several forests: majority vote (mean for regression). ``grid`` chooses depth and leaf size by a held-out share.

    Classifiers are fitted on ``final_rows`` rows at most, a sample by hash of the key, and their grid is searched on ``search_rows``; regressions are
    fitted on all rows. Without ``num_fits``, three forests vote where there are fewer than ``small`` rows, one beyond.
    """

    n_estimators: int = 32
    min_samples_leaf: int = 2
    max_depth: int = 10
    balanced: bool = False
    num_fits: int | None = None
    small: int = 2000
    grid: bool = False
    search_rows: int = 100_000
    final_rows: int = 1_500_000
    models: list = field(default_factory=list)

    def _estimator(self, i: int, depth: int, leaf: int):
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.regression import RandomForestRegressor

        common = {"numTrees": self.n_estimators, "minInstancesPerNode": leaf, "maxDepth": depth, "seed": self.seed + i, "labelCol": "__label", "featuresCol": "__features"}
        if not self.classifies:
            return RandomForestRegressor(predictionCol=f"__p{i}", **common)
        return RandomForestClassifier(weightCol="__weight", predictionCol=f"__p{i}", probabilityCol=f"__q{i}", rawPredictionCol=f"__r{i}", **common)

    def fit(self, df: DataFrame, target: str, key: str, features: Iterable[str] | None = None) -> Forest:
        x = self.prepare(df, target, key, features)
        x = (reshape.hashed_sample(x, self.final_rows, key, self.seed) if self.classifies else x).select(key, "__label", "__features")
        if self.classifies:
            if self.balanced:
                counts = {r["__label"]: r["count"] for r in x.groupBy("__label").count().collect()}
                n = sum(counts.values())
                w = F.create_map(*[F.lit(v) for k, c in counts.items() for v in (k, n / (len(counts) * c))])
                x = x.withColumn("__weight", w[F.col("__label")])
            else:
                x = x.withColumn("__weight", F.lit(1.0))
        x = x.cache()
        depth, leaf, rows = self.max_depth, self.min_samples_leaf, x.count()
        if self.grid:
            part = reshape.hashed_sample(x, self.search_rows, key, self.seed)
            held = F.pmod(F.xxhash64(key, F.lit(self.seed)), F.lit(4)) == 0
            best = None
            name = "f1Macro" if self.metric.startswith("roc") else self.metric
            for d in (4, 8, 12):
                for s in (1, 2, 4, 8):
                    m = self._estimator(0, d, s).fit(part.filter(~held))
                    v = METRICS.get(name, METRICS["f1Macro"])(m.transform(part.filter(held)), "__label", "__p0").first()[0]
                    if v is not None and (best is None or v >= best[0]):  # the last of equals
                        best = (v, d, s)
            depth, leaf = best[1:] if best else (depth, leaf)
        fits = self.num_fits or (3 if rows < self.small else 1)
        self.models = [self._estimator(i, depth, leaf).fit(x) for i in range(fits)]
        self.details = {"rows": rows, "fits": fits, "depth": depth, "leaf": leaf}
        x.unpersist()
        return self

    def predict(self, df: DataFrame, key: str) -> DataFrame:
        """key, prediction, and for classes an array of probabilities from the first forest."""
        from pyspark.ml.functions import vector_to_array

        x = assemble(df.select(key, *self.features), self.features)
        for m in self.models:
            x = m.transform(x)
        votes = F.array(*[F.col(f"__p{i}") for i in range(len(self.models))])
        if not self.classifies:
            return x.select(key, (F.aggregate(votes, F.lit(0.0), lambda a, b: a + b) / len(self.models)).alias("prediction"))
        # the most frequent, the first label of equals: votes are few, so they are counted within the row
        ballots = F.transform(F.array_distinct(votes), lambda v: F.struct((-F.size(F.filter(votes, lambda u: u == v))).alias("n"), v.alias("v")))
        return x.select(key, self.name_of(F.array_min(ballots)["v"]).alias("prediction"), vector_to_array("__q0").alias("probabilities"))

    def confidences(self, df: DataFrame, key: str, positive=None) -> DataFrame:
        """Two classes: key, label, confidence of the positive one; more: a row for each class."""
        p = self.predict(df, key)
        if len(self.labels) == 2:
            return p.select(key, F.col("prediction").alias("label"), reshape.binary_confidence(F.col("probabilities"), self.labels, positive).alias("confidence"))
        return reshape.explode_confidences(p, [key], F.col("probabilities"), self.labels)

    def importances(self, df: DataFrame) -> DataFrame:
        """Importances summed for the columns that features stem from: source, importance."""
        values = self.models[0].featureImportances.toArray().tolist()
        rows = df.sparkSession.createDataFrame(list(zip(self.features, values)), "feature string, importance double")
        return reshape.roll_up(rows, {c: M.source_column(df, c) for c in self.features})


@dataclass
class RankedLinearSVC(Learner):
    """Linear support vector classifier; confidence by Platt's scaling, sigmoid or softmax of the margin, and the margin's average rank."""

    scaling: str | None = "standardize"
    calibrate: bool = False
    regularization: float = 0.01
    iterations: int = 50
    moments: dict = field(default_factory=dict)
    models: list = field(default_factory=list)
    platt: list = field(default_factory=list)

    def _scaled(self, df: DataFrame) -> DataFrame:
        if self.scaling == "standardize":
            return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s or 1.0) for c, (m, s) in self.moments.items()})
        return clean.scale(df, self.features, "unit_norm") if self.scaling == "unit_norm" else df

    def fit(self, df: DataFrame, target: str, key: str, features: Iterable[str] | None = None) -> RankedLinearSVC:
        from pyspark.ml.classification import LinearSVC, LogisticRegression
        from pyspark.ml.functions import vector_to_array

        x = self.prepare(df, target, key, features).drop("__features")
        row = x.agg(*[v for i, c in enumerate(self.features) for v in (F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"))]).first()
        self.moments = {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(self.features)}
        x = assemble(self._scaled(x), self.features).select("__label", "__features").cache()
        self.models, self.platt = [], []
        for k in range(len(self.labels)) if len(self.labels) > 2 else (1,):
            y = x.withColumn("__y", (F.col("__label") == k).cast("double"))
            m = LinearSVC(labelCol="__y", featuresCol="__features", rawPredictionCol=f"__raw{k}", predictionCol=f"__y{k}", regParam=self.regularization, maxIter=self.iterations).fit(y)
            self.models.append((k, m))
            if self.calibrate:
                margin = assemble(m.transform(y).select("__y", vector_to_array(f"__raw{k}")[1].alias("__m")), ["__m"], "__v")
                p = LogisticRegression(labelCol="__y", featuresCol="__v").fit(margin)
                self.platt.append((float(p.coefficients[0]), float(p.intercept)))
        x.unpersist()
        return self

    def predict(self, df: DataFrame, key: str, positive=None) -> DataFrame:
        """Two classes: key, label, confidence, rank; more: a row for each class with its confidence and rank."""
        from pyspark.ml.functions import vector_to_array

        from fernlake.functions.metrics import average_rank
        from fernlake.functions.scalar import sigmoid

        x = assemble(self._scaled(df.select(key, *self.features)), self.features)
        for k, m in self.models:
            x = m.transform(x).withColumn(f"__d{k}", vector_to_array(f"__raw{k}")[1])
        if len(self.labels) == 2:
            d = F.col("__d1") if positive in (None, self.labels[1]) else -F.col("__d1")
            a, b = self.platt[0] if self.platt else (1.0, 0.0)
            p = F.lit(a) * F.col("__d1") + F.lit(b)
            p = sigmoid(p if positive in (None, self.labels[1]) else -p)
            y = x.select(key, self.name_of((F.col("__d1") > 0).cast("int")).alias("label"), p.alias("confidence"), F.round(d, 9).alias("__d"))
            return average_rank(y, "__d").drop("__d")
        margins = F.array(*[F.col(f"__d{k}") for k, _ in self.models])
        p = F.array(*[sigmoid(F.lit(a) * F.col(f"__d{k}") + F.lit(b)) for (k, _), (a, b) in zip(self.models, self.platt)]) if self.platt else encode.softmax(margins)
        e = reshape.explode_confidences(x.select(key, p.alias("p")), [key], F.col("p"), self.labels)
        return average_rank(e.withColumn("__c", F.round("confidence", 9)), "__c").drop("__c")


class KMeansLabels:
    """Numbers of the clusters of a frame, from a fit on that same frame."""

    def __init__(self, n_clusters: int = 8, column: str = "__cluster", seed: int = 0, restarts: int = 1):
        self.n_clusters, self.column, self.seed, self.restarts = n_clusters, column, seed, restarts

    def transform(self, df: DataFrame, key: str, features: Iterable[str] | None = None) -> DataFrame:
        from pyspark.ml.clustering import KMeans

        features = list(features) if features is not None else [c for c in M.numeric_only(df).columns if c != key]
        x = assemble(df.dropna(subset=features), features).cache()
        fits = [KMeans(k=self.n_clusters, seed=self.seed + i, featuresCol="__features", predictionCol=self.column).fit(x) for i in range(self.restarts)]
        best = min(fits, key=lambda m: m.summary.trainingCost)
        return best.transform(x).select(key, self.column)


class TextClassifier:
    """Term weights and a linear classifier against each other class; regularisation by cross-validation over hashed folds."""

    def __init__(self, metric: str = "f1Macro", grid: tuple[float, ...] = (0.001, 0.01, 0.1), folds: int = 3, size: int = 5000):
        self.metric, self.grid, self.folds, self.size, self.model, self.labels = metric, grid, folds, size, None, None

    def _fit(self, x: DataFrame, reg: float):
        from pyspark.ml.classification import LinearSVC, OneVsRest

        svc = LinearSVC(featuresCol="features", labelCol="__label", maxIter=30, regParam=reg)
        return svc.fit(x) if len(self.labels) == 2 else OneVsRest(classifier=svc, featuresCol="features", labelCol="__label").fit(x)

    def fit(self, df: DataFrame, text: str, label: str, key: str) -> TextClassifier:
        codes = encode.factorize(df, label, key)
        self.labels = [r[0] for r in codes.orderBy("code").collect()]
        x = df.join(F.broadcast(codes), F.col(label) == F.col("value")).withColumn("__label", F.col("code").cast("double"))
        self.text = encode.tfidf(x, text, 2, self.size)
        x = self.text.transform(x).select(key, "__label", "features").cache()
        best = None
        for reg in self.grid if len(self.grid) > 1 else ():
            scores = []
            for i in range(self.folds):
                held = F.pmod(F.xxhash64(key), F.lit(self.folds)) == i
                p = self._fit(x.filter(~held), reg).transform(x.filter(held))
                scores.append(METRICS[self.metric](p, "__label", "prediction").first()[0] or 0.0)
            if best is None or sum(scores) > best[0]:
                best = (sum(scores), reg)
        self.model = self._fit(x, best[1] if best else self.grid[0])
        x.unpersist()
        return self

    def predict(self, df: DataFrame, key: str) -> DataFrame:
        p = self.model.transform(self.text.transform(df))
        return p.select(key, F.get(F.array(*[F.lit(x) for x in self.labels]), F.col("prediction").cast("int")).alias("prediction"))


class Recommender:
    """Matrix factors of several ranks, averaged; a pair with an unknown side gets the mean rating."""

    def __init__(self, user: str, item: str, rating: str, ranks: tuple[int, ...] = (4, 8, 16), seed: int = 0, steps: int = 8):
        self.user, self.item, self.rating, self.ranks, self.seed, self.steps = user, item, rating, ranks, seed, steps

    def fit(self, df: DataFrame) -> Recommender:
        from pyspark.ml.recommendation import ALS

        self.users = encode.numbered(df.filter(F.col(self.user).isNotNull()), self.user, "__u")
        self.items = encode.numbered(df.filter(F.col(self.item).isNotNull()), self.item, "__i")
        x = self._ids(df).withColumn("__r", F.col(self.rating).cast("float")).cache()
        self.mean = x.agg(F.avg("__r")).first()[0]
        self.models = [ALS(rank=r, userCol="__u", itemCol="__i", ratingCol="__r", seed=self.seed, maxIter=self.steps, regParam=0.1).fit(x).setPredictionCol(f"__p{r}") for r in self.ranks]
        return self

    def _ids(self, df: DataFrame) -> DataFrame:
        x = df.join(self.users, self.user, "left").join(self.items, self.item, "left")
        return x.withColumns({c: F.coalesce(F.col(c), F.lit(-1)).cast("int") for c in ("__u", "__i")})

    def predict(self, df: DataFrame) -> DataFrame:
        x = self._ids(df)
        for m in self.models:
            x = m.transform(x)
        total = sum((F.when(F.isnan(f"__p{r}"), F.lit(self.mean)).otherwise(F.coalesce(F.col(f"__p{r}"), F.lit(self.mean))) for r in self.ranks), F.lit(0.0))
        return x.withColumn("prediction", total / len(self.ranks)).drop("__u", "__i", *[f"__p{r}" for r in self.ranks])


def baseline(df: DataFrame, target: str, metric: str):
    """The constant that a metric is best served by: mean, median or most frequent value; None for ranking metrics (chance)."""
    if metric in ("meanSquaredError", "rootMeanSquaredError", "rootMeanSquaredErrorAvg", "rSquared"):
        return df.agg(F.avg(target)).first()[0]
    if metric == "meanAbsoluteError":
        return quantiles(df, F.col(target), [0.5])[0]
    if metric in CLASSIFICATION:
        return df.agg(F.mode(target, True)).first()[0]
    return None


def fold_count(df: DataFrame, label: str, most: int = 5) -> int:
    """Folds that each class has members for."""
    return max(0, min(most, df.groupBy(label).count().agg(F.min("count")).first()[0] or 0))


def random_features(df: DataFrame, columns: list[str], n: int = 64, gamma: float = 1.0, seed: int = 0) -> DataFrame:
    """Random Fourier features of the radial kernel, for linear learners in place of a kernel machine."""
    import numpy as np

    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, np.sqrt(2 * gamma), (n, len(columns))), rng.uniform(0, 2 * np.pi, n)
    return df.withColumns({f"__rff_{i}": F.lit(float(np.sqrt(2 / n))) * F.cos(sum((F.col(c) * F.lit(float(w[i, j])) for j, c in enumerate(columns)), F.lit(float(b[i])))) for i in range(n)})


def tree_path_contributions(model, df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """Contribution of each feature to each prediction of a forest regressor: differences of node means along the paths (key, feature, value).

    The trees travel as small tables of nodes; rows are walked in Arrow batches.
    """
    import numpy as np
    import pandas as pd

    def flat(node, out):
        at = len(out)
        out.append(None)
        if node.numDescendants() == 0:
            out[at] = (-1, 0.0, 0, 0, node.prediction(), node.impurityStats().count())
        else:
            l, r = flat(node.leftChild(), out), flat(node.rightChild(), out)
            n = out[l][5] + out[r][5]
            out[at] = (node.split().featureIndex(), node.split().threshold(), l, r, (out[l][4] * out[l][5] + out[r][4] * out[r][5]) / n, n)
        return at

    trees = []
    for t in model.trees:
        nodes: list = []
        flat(t._call_java("rootNode"), nodes)
        trees.append(nodes)

    def run(batches):
        for b in batches:
            x, rows = b[features].to_numpy(float), []
            for k, v in zip(b[key], x):
                phi = np.zeros(len(features))
                for nodes in trees:
                    at = 0
                    while nodes[at][0] >= 0:
                        f, t, l, r, mean, _ = nodes[at]
                        nxt = l if v[f] <= t else r
                        phi[f] += nodes[nxt][4] - mean
                        at = nxt
                phi /= len(trees)
                rows += [(k, c, p) for c, p in zip(features, phi)]
            yield pd.DataFrame(rows, columns=[key, "feature", "value"])

    return df.select(key, *features).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, feature string, value double")
