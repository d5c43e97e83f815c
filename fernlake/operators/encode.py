"""Encoders: categories, codes, text weighting and histograms."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernlake import metadata as M
from fernlake.plans.lineage import cut
from fernlake.plans.ordered import offsets, quantiles, ranged

#: Rows up to which a table of codes is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 200_000
TERM = r"(?U)\b\w\w+\b"


def cardinalities(df: DataFrame, columns: Iterable[str]) -> dict[str, int]:
    """Distinct values of each column in one pass; null counts as a value."""
    cols = list(columns)
    if not cols:
        return {}
    row = df.agg(*[(F.count_distinct(F.col(c)) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in cols]).first()
    return {c: row[c] or 0 for c in cols}


class _Fitted:
    def get_params(self) -> dict:
        return dict(vars(self))

    def set_params(self, params: dict):
        vars(self).update(params)
        return self


class OneHotEncoder(_Fitted):
    """Columns of few values become one 0/1 column a value, numbered through; a value not seen in fitting gives zeros."""

    def __init__(self, max_one_hot: int = 16, use_columns=None):
        self.max_one_hot, self.use_columns, self.levels = max_one_hot, use_columns, None

    def fit(self, df: DataFrame, columns: Iterable[str] | None = None) -> OneHotEncoder:
        cols = list(columns) if columns is not None else M.operating_columns(df, self.use_columns, M.CATEGORICALS)
        few = [c for c, n in cardinalities(df, cols).items() if n <= self.max_one_hot]
        row = df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in few]).first() if few else {}  # at most max_one_hot values each
        self.levels = {c: list(row[c]) for c in few}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.levels:
            return df
        pairs = [(c, v) for c, vs in self.levels.items() for v in vs]
        new = {f"__onehot_{i}": F.coalesce(F.col(c) == F.lit(v), F.lit(False)).cast("double") for i, (c, v) in enumerate(pairs)}
        out = df.withColumns(new).drop(*self.levels)
        for i, (c, _) in enumerate(pairs):
            out = out.withMetadata(f"__onehot_{i}", {"semantic_types": ["Attribute", "Float"], "source_column": c})
        return out


class BinaryEncoder(_Fitted):
    """Columns of many values become the bits, highest first, of the value's number among the sorted values.

    The missing token is a value like others and stands for null and for any value not seen in fitting.
    """

    def __init__(self, min_binary: int = 17, use_columns=None):
        self.min_binary, self.use_columns, self.codes, self.sizes = min_binary, use_columns, None, None

    def fit(self, df: DataFrame, columns: Iterable[str] | None = None) -> BinaryEncoder:
        cols = list(columns) if columns is not None else M.operating_columns(df, self.use_columns, M.CATEGORICALS)
        many = [c for c, n in cardinalities(df, cols).items() if n >= self.min_binary]
        self.codes, self.sizes = {}, {}
        for c in many:
            levels = df.select(F.coalesce(F.col(c).cast("string"), F.lit(M.MISSING)).alias("level")).union(df.sparkSession.range(1).select(F.lit(M.MISSING).alias("level"))).distinct()
            self.codes[c] = numbered(levels, "level", "code")
            self.sizes[c] = self.codes[c].count()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.codes:
            return df
        out, number = df, 0
        for c, codes in self.codes.items():
            n = self.sizes[c]
            table = codes.toDF(f"__l_{c}", f"__k_{c}")
            missing = codes.filter(F.col("level") == M.MISSING).select(F.col("code").alias(f"__m_{c}"))
            small = n <= BROADCAST_ROWS
            out = out.join(F.broadcast(table) if small else table, F.coalesce(F.col(c).cast("string"), F.lit(M.MISSING)) == F.col(f"__l_{c}"), "left").crossJoin(F.broadcast(missing))  # one row
            code, width = F.coalesce(F.col(f"__k_{c}"), F.col(f"__m_{c}")), max(1, (n - 1).bit_length())
            bits = {f"__binary_{number + j}": F.shiftright(code, width - 1 - j).bitwiseAND(F.lit(1)).cast("int") for j in range(width)}
            out = out.withColumns(bits).drop(f"__l_{c}", f"__k_{c}", f"__m_{c}", c)
            for b in bits:
                out = out.withMetadata(b, {"semantic_types": ["Attribute", "Integer"], "source_column": c})
            number += width
        return out


def numbered(df: DataFrame, column: str, to: str, start: int = 0) -> DataFrame:
    """Distinct values with their dense number in sorted order, without bringing all rows into one task.

    Values are sorted by range into partitions; a partition's numbers begin after the sizes of those before, which are counted
    and sent as one literal.
    """
    parts = ranged(df.select(column).distinct(), column)
    before = offsets(parts, F.count("*"), start)
    if before is None:
        return df.select(column).limit(0).withColumn(to, F.lit(0).cast("long"))
    own = F.row_number().over(Window.partitionBy("__p").orderBy(column)) - 1
    return parts.select(column, (before + own).cast("long").alias(to))


def factorize(df: DataFrame, column: str, key: str, to: str = "code", start: int = 0) -> DataFrame:
    """Codes in the order of first appearance by key, as (value, code); null has no code."""
    first = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(key).alias("__first"))
    codes = numbered(first.select(F.struct("__first", "value").alias("__o")), "__o", to, start)
    return codes.select(F.col("__o.value").alias("value"), to)


def label_encode(df: DataFrame, column: str, codes: DataFrame, to: str, unseen: int = 0) -> DataFrame:
    """Look up codes (value, code) for a column; a value without one gets ``unseen``."""
    c = codes.select(F.col("value").alias("__value"), F.col("code").alias("__code"))
    out = df.join(c, F.col(column) == F.col("__value"), "left")
    return out.withColumn(to, F.coalesce("__code", F.lit(unseen)).cast("long")).drop("__value", "__code")


def remap_ids(train: DataFrame, test: DataFrame, column: str, to: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dense numbers of the sorted ids of both frames; both frames with them, and the table of (id, number)."""
    ids = numbered(train.select(column).union(test.select(column)).filter(F.col(column).isNotNull()), column, to)
    return train.join(ids, column), test.join(ids, column), ids


def looks_like_text(df: DataFrame, column: str, least: float = 8.0) -> bool:
    """Whether half of the values have at least so many parts between spaces."""
    (m,) = quantiles(df.filter(F.col(column).isNotNull()), F.size(F.split(column, " ")), [0.5])
    return m is not None and m >= least


def run_lengths(df: DataFrame, group: str, order: Iterable[str], value: str) -> DataFrame:
    """group, run, n: lengths of the runs of equal values, in order."""
    w = Window.partitionBy(group).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(group, "run").agg(F.count("*").alias("n"))


def run_length_histogram(train: DataFrame, test: DataFrame, group: str, order: Iterable[str], value: str, at: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Histograms of run lengths for each group, as (group, length, n); lengths are cut off at a percentile of the training runs."""
    a, b = run_lengths(train, group, order, value), run_lengths(test, group, order, value)
    top = int(quantiles(a, F.col("n"), [at])[0] or 0)
    return tuple(x.groupBy(group, F.least("n", F.lit(top)).alias("length")).agg(F.count("*").alias("n")) for x in (a, b))


def vector_histogram(df: DataFrame, group: str, vector: str, k: int = 64, seed: int = 0) -> DataFrame:
    """Sets of vectors as counts of their nearest codebook entry: (group, code, n)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = df.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(featuresCol="__v", predictionCol="code", k=k, seed=seed, maxIter=10).fit(v)
    return model.transform(v).groupBy(group, "code").agg(F.count("*").alias("n"))


def terms(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0))


def document_frequencies(df: DataFrame, column: str) -> DataFrame:
    """term, df: in how many texts each term occurs."""
    return df.select(F.explode(F.array_distinct(terms(F.col(column)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def inverse_frequencies(df: DataFrame, column: str) -> DataFrame:
    """term, df, idf, with the smoothed idf ln((1 + n) / (1 + df)) + 1."""
    n = df.filter(F.col(column).isNotNull()).agg(F.count("*").alias("n"))
    return document_frequencies(df, column).crossJoin(F.broadcast(n)).select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def vocabulary(df: DataFrame, words: Column, ngrams: int, size: int) -> list[str]:
    """The most frequent 1- to n-grams of arrays of words, of equals the lesser ones first.

    A gram is no more frequent than its rarest word, so the grams sought consist of words that are at least as frequent as the last of the ``size``
    most frequent ones. Others aren't counted, unless so many words are equals of that one that all are.
    """
    def top(counts):
        return [tuple(r) for r in counts.orderBy(F.desc("n"), "term").limit(size).collect()]

    one = cut(df.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n")))
    found = top(one)
    if ngrams > 1 and len(found) == size:
        known = [r[0] for r in one.filter(F.col("n") >= found[-1][1]).select("term").limit(4 * size + 1).collect()]
        if len(known) <= 4 * size:
            words = F.transform(words, lambda w: F.when(w.isin(known), w))
    for n in range(2, ngrams + 1):
        parts = [F.slice(F.col("__w"), i + 1, F.greatest(F.size("__w") - n + 1, F.lit(0))) for i in range(n)]
        grams = df.select(words.alias("__w")).select(F.explode(F.arrays_zip(*parts)).alias("__g")).select("__g.*").toDF(*[f"__{i}" for i in range(n)]).dropna()
        counts = grams.groupBy(*grams.columns).agg(F.count("*").alias("n"))
        found += top(counts.select(F.concat_ws(" ", *grams.columns).alias("term"), "n"))
    return [t for t, _ in sorted(found, key=lambda x: (-x[1], x[0]))[:size]]


def tfidf(df: DataFrame, column: str, ngrams: int = 2, size: int = 30_000, to: str = "features"):
    """A fitted pipeline: terms, 1- to n-grams, the most frequent of them, smoothed idf and unit length."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import CountVectorizerModel, IDF, NGram, Normalizer, SQLTransformer

    stages = [SQLTransformer(statement=f"SELECT *, regexp_extract_all(lower(coalesce(`{column}`, '')), '(?U)\\\\b\\\\w\\\\w+\\\\b', 0) AS __w1 FROM __THIS__")]
    stages += [NGram(n=n, inputCol="__w1", outputCol=f"__w{n}") for n in range(2, ngrams + 1)]
    stages.append(SQLTransformer(statement="SELECT *, concat(" + ", ".join(f"__w{n}" for n in range(1, ngrams + 1)) + ") AS __grams FROM __THIS__"))
    known = vocabulary(stages[0].transform(df), F.col("__w1"), ngrams, size)
    stages += [CountVectorizerModel.from_vocabulary(known, inputCol="__grams", outputCol="__tf"), IDF(inputCol="__tf", outputCol="__idf"), Normalizer(inputCol="__idf", outputCol=to)]
    return Pipeline(stages=stages).fit(df)


class TextEncoder(_Fitted):
    """Text columns to numbers: ``svm`` gives each class's decision value (one for two classes, the prediction for regression),
    ``tfidf`` codes of texts that repeat and else 16 centred principal components of the term weights. Columns are numbered through as ``__text_i``."""

    def __init__(self, kind: str = "svm", metric: str = "f1Macro", components: int = 16, size: int = 3000):
        self.kind, self.metric, self.components, self.size, self.parts = kind, metric, components, size, None

    def fit(self, df: DataFrame, columns: Iterable[str], label: str | None = None, key: str | None = None) -> TextEncoder:
        self.parts = [(c, self._fit_one(df, c, label, key)) for c in columns]
        return self

    def _fit_one(self, df, c, label, key):
        from pyspark.ml.classification import LinearSVC
        from pyspark.ml.feature import PCA, StandardScaler
        from pyspark.ml.regression import LinearRegression

        from fernlake.functions.metrics import REGRESSION

        if self.kind == "tfidf":
            distinct, total = df.agg(F.count_distinct(c), F.count(c)).first()
            if total and distinct / total < 0.5:
                return "codes", factorize(df, c, key)
            text = tfidf(df, c, 1, 300)
            x = text.transform(df)
            center = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="__centred").fit(x)
            k = min(self.components, len(text.stages[-3].vocabulary))
            return "pca", text, center, PCA(k=k, inputCol="__centred", outputCol="__pca").fit(center.transform(x)), k
        if self.metric in REGRESSION:
            text = tfidf(df, c, 2, self.size)
            return "regression", text, LinearRegression(labelCol=label, regParam=0.1, predictionCol="__p").fit(text.transform(df))
        counts = df.groupBy(label).count().collect()
        if min(r["count"] for r in counts) < 2:
            raise ValueError("every class needs two members at least")
        text = tfidf(df, c, 2, self.size)
        x, n = text.transform(df).cache(), sum(r["count"] for r in counts)
        classes = sorted(counts, key=lambda r: r[0])
        models = []
        for r in classes if len(classes) > 2 else classes[1:]:
            rare = n / (2.0 * r["count"])
            y = x.withColumn("__y", (F.col(label) == F.lit(r[0])).cast("double")).withColumn("__wt", F.when(F.col("__y") == 1, rare).otherwise(n / (2.0 * (n - r["count"]))))
            models.append(LinearSVC(labelCol="__y", weightCol="__wt", featuresCol="features", maxIter=30, regParam=1e-3).fit(y))
        x.unpersist()
        return "svm", text, models

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        out, number = df, 0
        for c, (kind, *m) in self.parts:
            own = []
            if kind == "codes":
                out = label_encode(out, c, m[0], "__code_out").withColumn(f"__text_{number}", F.col("__code_out").cast("double")).drop("__code_out")
                own = [f"__text_{number}"]
            else:
                keep = out.columns
                x = m[0].transform(out)
                if kind == "pca":
                    x = m[2].transform(m[1].transform(x)).withColumn("__a", vector_to_array("__pca"))
                    own = [f"__text_{number + i}" for i in range(m[3])]
                    x = x.withColumns({n: F.col("__a")[i] for i, n in enumerate(own)})
                elif kind == "regression":
                    own = [f"__text_{number}"]
                    x = m[1].transform(x).withColumn(own[0], F.col("__p"))
                else:
                    own = [f"__text_{number + i}" for i in range(len(m[1]))]
                    for n, model in zip(own, m[1]):
                        x = model.setRawPredictionCol("__raw").setPredictionCol("__p").transform(x).withColumn(n, vector_to_array("__raw")[1]).drop("__raw", "__p")
                out = x.select(*keep, *own)
            for n in own:
                out = out.withMetadata(n, {"semantic_types": ["Attribute", "Float"], "source_column": c})
            out, number = out.drop(c), number + len(own)
        return out


def whiten(train: DataFrame, test: DataFrame, features: str, k: int, to: str = "whitened") -> tuple[DataFrame, DataFrame]:
    """Principal components of both frames together, centred and of unit variance; for vector columns."""
    from pyspark.ml.feature import PCA, StandardScaler

    both = train.select(features).union(test.select(features))
    center = StandardScaler(withMean=True, withStd=False, inputCol=features, outputCol="__c").fit(both)
    pca = PCA(k=k, inputCol="__c", outputCol="__p").fit(center.transform(both))
    unit = StandardScaler(withMean=False, withStd=True, inputCol="__p", outputCol=to).fit(pca.transform(center.transform(both)))
    return tuple(unit.transform(pca.transform(center.transform(x))).drop("__c", "__p") for x in (train, test))


def softmax(values: Column) -> Column:
    """Shifted exponentials of an array, summing to one."""
    e = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
