"""Named queries over the driver's tables, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernlake import metadata as M
from fernlake.functions import metrics as K
from fernlake.functions import scalar as S
from fernlake.operators import clean, encode, graph, learn, neighbors, reshape
from fernlake.plans.lineage import written
from fernlake.plans.ordered import quantiles
from fernlake.plans.parts import distinct, spread

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def r6(c):
    """Rounded to six digits, -0 made 0, as both engines print it."""
    return F.round(c, 6) + F.lit(0.0)


# Cleaning


@query("replace_singletons", f"SELECT p_partkey, CASE WHEN p_name IS NOT NULL AND count(*) OVER (PARTITION BY p_name) = 1 THEN '{M.SINGLETON}' ELSE p_name END AS p_name FROM part")
def replace_singletons(spark, d):
    return clean.replace_singletons(read(spark, d, "part").select("p_partkey", "p_name"), columns=["p_name"])


BLANKED = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END AS p FROM orders"


def blanked(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_orderpriority")).alias("p"))


@query("impute_mode", f"WITH b AS ({BLANKED}), m AS (SELECT p FROM b WHERE p <> '' GROUP BY p ORDER BY count(*) DESC, p LIMIT 1) SELECT o_orderkey, CASE WHEN b.p = '' THEN (SELECT p FROM m) ELSE b.p END AS p FROM b")
def impute_mode(spark, d):
    b = blanked(spark, d)
    return clean.Imputer().fit(b, ["p"]).transform(b)


@query("impute_constant", f"SELECT o_orderkey, CASE WHEN p = '' THEN '{M.MISSING}' ELSE p END AS p FROM ({BLANKED})")
def impute_constant(spark, d):
    b = blanked(spark, d)
    return clean.Imputer("constant").fit(b, ["p"]).transform(b)


@query("parse_numbers", "SELECT o_orderkey, CAST(o_orderkey AS BIGINT) AS k, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE round(o_totalprice, 6) END AS price FROM orders")
def parse_numbers(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("k"), F.when(F.col("o_orderkey") % 5 == 0, "1d").otherwise(F.col("o_totalprice").cast("string")).alias("price"))
    o = M.tag(o, {"k": ("Integer", M.ATTRIBUTE), "price": ("Float", M.ATTRIBUTE)})
    return clean.parse_columns(o).withColumn("price", F.round("price", 6))


@query("parse_vectors", "SELECT vec_id, " + ", ".join(f"round(CAST(round(embedding[{i + 1}], 3) AS DOUBLE), 3) + 0.0 AS v{i}" for i in range(3)) + " FROM embeddings")
def parse_vectors(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.array_join(F.transform(F.slice("embedding", 1, 3), lambda x: F.round(x, 3).cast("string")), ",").alias("v"))
    v = clean.parse_columns(M.tag(e, {"v": ("FloatVector",)}))
    return v.select("vec_id", *[(F.round(F.col("v")[i], 3) + F.lit(0.0)).alias(f"v{i}") for i in range(3)])


@query("parse_dates", "SELECT o_orderkey, epoch(o_orderdate) AS t FROM orders")
def parse_dates(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "MMM d yyyy HH:mm:ss").alias("t"))
    return clean.parse_columns(M.tag(o, {"t": ("DateTime",)}), fuzzy_dates=False)


@query("enrich_dates", "WITH s AS (SELECT o_orderkey, epoch(o_orderdate) - 946684800 AS x FROM orders) SELECT o_orderkey, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 6) + 0.0 AS z FROM s")
def enrich_dates(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return clean.enrich_dates(o, columns=["o_orderdate"]).select("o_orderkey", r6(F.col("__date_0")).alias("z"))


@query("list_expand", "SELECT vec_id, " + ", ".join(f"embedding[{i + 1}] AS embedding_{i}" for i in range(64)) + " FROM embeddings")
def list_expand(spark, d):
    return clean.expand_lists(read(spark, d, "embeddings").select("vec_id", "embedding"), ["embedding"])


@query("drop_incomplete", "SELECT event_id, event_type, value FROM events WHERE event_type IS NOT NULL AND event_type <> '' AND value IS NOT NULL AND NOT isnan(value)")
def drop_incomplete(spark, d):
    return clean.drop_incomplete(read(spark, d, "events").select("event_id", "event_type", "value"), "event_type", ["value"])


@query("standardize", "SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) + 0.0 AS q FROM lineitem")
def standardize(spark, d):
    x = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"))
    return clean.scale(x, ["q"]).withColumn("q", r6(F.col("q")))


@query("unit_norm", "SELECT l_orderkey, l_linenumber, round(l_discount / sqrt(l_discount * l_discount + l_tax * l_tax + l_quantity * l_quantity), 6) AS a FROM lineitem")
def unit_norm(spark, d):
    x = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("a"), F.col("l_tax").alias("b"), F.col("l_quantity").alias("c"))
    return clean.scale(x, ["a", "b", "c"], "unit_norm").select("l_orderkey", "l_linenumber", F.round("a", 6).alias("a"))


# Encoders


@query("one_hot", "SELECT c_custkey, " + ", ".join(f"CAST(c_mktsegment = '{s}' AS DOUBLE) AS __onehot_{i}" for i, s in enumerate(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))) + " FROM customer")
def one_hot(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return encode.OneHotEncoder().fit(c, ["c_mktsegment"]).transform(c)


@query(
    "binary_encode",
    f"WITH l AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT p_brand AS v FROM part UNION SELECT '{M.MISSING}')) SELECT p_partkey, " + ", ".join(f"CAST((code >> {4 - j}) & 1 AS INTEGER) AS __binary_{j}" for j in range(5)) + " FROM part JOIN l ON v = p_brand",
)
def binary_encode(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_brand")
    return encode.BinaryEncoder().fit(p, ["p_brand"]).transform(p)


@query("factorize", "WITH f AS (SELECT p_brand AS value, min(p_partkey) AS k FROM part GROUP BY 1) SELECT value, CAST(row_number() OVER (ORDER BY k, value) - 1 AS BIGINT) AS code FROM f")
def factorize(spark, d):
    return encode.factorize(read(spark, d, "part"), "p_brand", "p_partkey")


@query(
    "label_encode",
    "WITH t AS (SELECT * FROM part WHERE p_partkey % 2 = 0 AND p_size < 25), f AS (SELECT p_type AS value, min(p_partkey) AS k FROM t GROUP BY 1), c AS (SELECT value, row_number() OVER (ORDER BY k, value) AS code FROM f) SELECT p_partkey, CAST(coalesce(code, 0) AS BIGINT) AS code FROM part LEFT JOIN c ON p_type = value",
)
def label_encode(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_type", "p_size")
    codes = encode.factorize(p.filter("p_partkey % 2 = 0 and p_size < 25"), "p_type", "p_partkey", start=1)
    return encode.label_encode(p, "p_type", codes, "code").select("p_partkey", "code")


@query(
    "remap_ids",
    "WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 3 = 0), ids AS (SELECT o_custkey, CAST(dense_rank() OVER (ORDER BY o_custkey) - 1 AS BIGINT) AS id FROM (SELECT * FROM a UNION SELECT * FROM b)) SELECT o_orderkey, o_custkey, id FROM orders JOIN ids USING (o_custkey) WHERE o_orderkey % 3 = 0",
)
def remap_ids(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    return encode.remap_ids(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 3 = 0"), "o_custkey", "id")[1].select("o_orderkey", "o_custkey", "id")


RUNS = "WITH e AS (SELECT *, row_number() OVER w AS i, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT user_id, sum(CASE WHEN i = 1 OR before IS DISTINCT FROM event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e), n AS (SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS n FROM r GROUP BY 1, 2)"


@query("run_lengths", RUNS + " SELECT * FROM n")
def run_lengths(spark, d):
    return encode.run_lengths(read(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("run_length_histogram", RUNS + ", t AS (SELECT CAST(trunc(quantile_cont(n, 0.95)) AS BIGINT) AS top FROM n) SELECT user_id, least(n, top) AS length, count(*) AS n FROM n, t GROUP BY 1, 2")
def run_length_histogram(spark, d):
    e = read(spark, d, "events")
    return encode.run_length_histogram(e, e, "user_id", ["ts", "event_id"], "event_type")[0].withColumn("length", F.col("length").cast("long"))


WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_\p{M}]{2,}')"


@query("terms", f"SELECT doc_id, CAST(len({WORDS}) AS BIGINT) AS n FROM documents")
def terms(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(encode.terms(F.col("text"))).cast("long").alias("n"))


@query("idf", f"WITH t AS (SELECT DISTINCT doc_id, unnest({WORDS}) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL) SELECT term, count(*) AS df, round(ln((1 + any_value(n)) / (1 + count(*))) + 1, 6) AS idf FROM t, n GROUP BY term")
def idf(spark, d):
    return encode.inverse_frequencies(read(spark, d, "documents"), "text").withColumn("idf", F.round("idf", 6))


@query("token_median", "SELECT median(len(string_split(text, ' '))) AS m FROM documents WHERE text IS NOT NULL")
def token_median(spark, d):
    (m,) = quantiles(read(spark, d, "documents").filter("text is not null"), S.token_count(F.col("text")), [0.5])
    return spark.range(1).select(F.lit(m).cast("double").alias("m"))


@query("cardinalities", "SELECT CAST(count(DISTINCT p_brand) AS BIGINT) AS brand, CAST(count(DISTINCT p_type) AS BIGINT) AS type, CAST(count(DISTINCT p_size) AS BIGINT) AS size FROM part")
def cardinalities(spark, d):
    p = read(spark, d, "part")
    n = encode.cardinalities(p, ["p_brand", "p_type", "p_size"])
    return spark.range(1).select(*[F.lit(n[f"p_{c}"]).cast("long").alias(c) for c in ("brand", "type", "size")])


@query(
    "encode_features",
    f"""WITH a AS (SELECT p_partkey, p_size, CASE WHEN count(*) OVER (PARTITION BY p_name) = 1 THEN '{M.SINGLETON}' ELSE p_name END AS p_name, p_type FROM part),
    t AS (SELECT DISTINCT p_type FROM a), n AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS i FROM t),
    l AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code, count(*) OVER () AS k FROM (SELECT DISTINCT p_name AS v FROM a UNION SELECT '{M.MISSING}'))
    SELECT p_partkey, p_size, i AS type_place, CAST(code AS BIGINT) AS name_code FROM a JOIN n USING (p_type) JOIN l ON v = p_name""",
)
def encode_features(spark, d):
    """Flagship: impute, fold rare values, one-hot and binary encode; the result says which column is hot and which number the bits make."""
    p = read(spark, d, "part").select("p_partkey", "p_size", "p_name", "p_type")
    p = clean.Imputer().fit(p, ["p_name", "p_type"]).transform(p)
    p = clean.replace_singletons(p, columns=["p_name"])
    one = encode.OneHotEncoder().fit(p, ["p_type"])
    two = encode.BinaryEncoder().fit(p, ["p_name"])
    x = two.transform(one.transform(p))
    hot = [c for c in x.columns if c.startswith("__onehot_")]
    bits = [c for c in x.columns if c.startswith("__binary_")]
    place = F.array_position(F.array(*hot), F.lit(1.0)) - 1
    number = sum((F.col(c).cast("long") * F.lit(1 << (len(bits) - 1 - i)) for i, c in enumerate(bits)), F.lit(0).cast("long"))
    return x.select("p_partkey", "p_size", place.cast("long").alias("type_place"), number.alias("name_code"))


# Votes, ranks, samples


@query("avg_rank", "SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rank FROM lineitem")
def avg_rank(spark, d):
    return K.average_rank(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity").drop("l_quantity")


@query("equal_length", "WITH m AS (SELECT min(n) AS m FROM (SELECT user_id, count(value) AS n FROM events GROUP BY 1)) SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events), m WHERE i < m")
def equal_length(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return reshape.equal_length(e, "user_id", ["ts", "event_id"], "value").select("event_id", "user_id")


@query("majority_vote", "WITH n AS (SELECT user_id, event_type, count(*) AS votes, min(event_id) AS f FROM events GROUP BY 1, 2) SELECT user_id, event_type, votes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, f) AS i FROM n) WHERE i = 1")
def majority_vote(spark, d):
    return reshape.majority_vote(read(spark, d, "events"), "user_id", "event_type", "event_id")


@query("confidence_explode", "SELECT event_id, unnest(['a', 'b']) AS label, round(unnest([1 / (1 + exp(-value / 100)), 1 - 1 / (1 + exp(-value / 100))]), 6) AS confidence FROM events WHERE value IS NOT NULL")
def confidence_explode(spark, d):
    e = read(spark, d, "events").filter("value is not null")
    p = S.sigmoid(F.col("value") / 100)
    return reshape.explode_confidences(e, ["event_id"], F.array(p, 1 - p), ["a", "b"]).withColumn("confidence", F.round("confidence", 6))


@query("softmax", "WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings) SELECT vec_id, round(exp(a - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 6) AS p FROM e")
def softmax(spark, d):
    e = read(spark, d, "embeddings")
    v = F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double"))
    return e.select("vec_id", F.round(encode.softmax(v)[0], 6).alias("p"))


@query("head_share", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS i, count(*) OVER () AS n FROM events) WHERE i <= floor(n * 0.25)")
def head_share(spark, d):
    return reshape.prefix(read(spark, d, "events").select("event_id"), 0.25, ["event_id"])


@query("first_of_group", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) WHERE i = 1")
def first_of_group(spark, d):
    return reshape.first_of_group(read(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).drop("ts")


@query("main_series_join", "SELECT o_orderkey, o_custkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS number FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def main_series_join(spark, d):
    o, li = read(spark, d, "orders").select("o_orderkey", "o_custkey"), read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey", "l_extendedprice")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return reshape.within_group_number(j, "o_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("o_orderkey", "o_custkey", "l_linenumber", "l_quantity", "number")


@query("hashed_sample")
def hashed_sample(spark, d):
    return reshape.hashed_sample(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), 100, "c_custkey")


@query("stratified_sample")
def stratified_sample(spark, d):
    return reshape.stratified_sample(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", 100, "c_custkey")


# Metrics

PREDICTED = "SELECT doc_id, quality AS a, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS p FROM labels"


def predicted(spark, d):
    return read(spark, d, "labels").select("doc_id", F.col("quality").alias("a"), F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("p"))


def value(df):
    return df.select(r6(F.col("value").cast("double")).alias("value"))


CONFUSION = f"WITH x AS ({PREDICTED}), l AS (SELECT a AS label FROM x UNION SELECT p FROM x), c AS (SELECT label, count(*) FILTER (a = label AND p = label) AS tp, count(*) FILTER (a <> label AND p = label) AS fp, count(*) FILTER (a = label AND p <> label) AS fn FROM x, l GROUP BY label)"


@query("confusion", CONFUSION + " SELECT CAST(label AS INTEGER) AS label, tp, fp, fn FROM c")
def confusion(spark, d):
    return K.confusion(predicted(spark, d), "a", "p").select(F.col("label").cast("int").alias("label"), *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])


@query("f1_macro", CONFUSION + " SELECT round(avg(2.0 * tp / (2 * tp + fp + fn)), 6) AS value FROM c")
def f1_macro(spark, d):
    return value(K.f1_macro(predicted(spark, d), "a", "p"))


@query("f1_micro", CONFUSION + " SELECT round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS value FROM c")
def f1_micro(spark, d):
    return value(K.f1_micro(predicted(spark, d), "a", "p"))


@query("f1_binary", CONFUSION + " SELECT round(2.0 * tp / (2 * tp + fp + fn), 6) AS value FROM c WHERE label = 1")
def f1_binary(spark, d):
    return value(K.f1_binary(predicted(spark, d), "a", "p"))


@query("accuracy", f"SELECT round(avg(CASE WHEN a = p THEN 1.0 ELSE 0.0 END), 6) AS value FROM ({PREDICTED})")
def accuracy(spark, d):
    return value(K.accuracy(predicted(spark, d), "a", "p"))


REGRESSED = "SELECT l_quantity AS a, l_extendedprice / 2000 AS p FROM lineitem"


def regressed(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 2000).alias("p"))


@query("mean_squared_error", f"SELECT round(-avg((a - p) * (a - p)), 6) AS value FROM ({REGRESSED})")
def mean_squared_error(spark, d):
    return value(K.mean_squared_error(regressed(spark, d), "a", "p"))


@query("mean_absolute_error", f"SELECT round(-avg(abs(a - p)), 6) AS value FROM ({REGRESSED})")
def mean_absolute_error(spark, d):
    return value(K.mean_absolute_error(regressed(spark, d), "a", "p"))


@query("root_mean_squared_error", f"SELECT round(-sqrt(avg((a - p) * (a - p))), 6) AS value FROM ({REGRESSED})")
def root_mean_squared_error(spark, d):
    return value(K.root_mean_squared_error(regressed(spark, d), "a", "p"))


@query("r_squared", f"SELECT round(1 - sum((a - p) * (a - p)) / (var_pop(a) * count(a)), 6) AS value FROM ({REGRESSED})")
def r_squared(spark, d):
    return value(K.r_squared(regressed(spark, d), "a", "p"))


@query(
    "normalized_mutual_information",
    "WITH j AS (SELECT quality AS a, toxic AS p, CAST(count(*) AS DOUBLE) AS n FROM labels GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY p) AS np, sum(n) OVER () AS t FROM j), s AS (SELECT sum(n / t * ln(n * t / (na * np))) AS mi, -sum(n / t * ln(na / t)) AS ha, -sum(n / t * ln(np / t)) AS hp FROM w) SELECT round(2 * mi / (ha + hp), 6) + 0.0 AS value FROM s",
)
def normalized_mutual_information(spark, d):
    return value(K.normalized_mutual_information(read(spark, d, "labels"), "quality", "toxic"))


SCORED = "SELECT quality AS y, CAST(n_chars % 1000 AS DOUBLE) AS s FROM documents JOIN labels USING (doc_id)"


@query("roc_auc", f"WITH x AS ({SCORED}), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM x), c AS (SELECT CAST(sum(y) AS DOUBLE) AS p, CAST(sum(1 - y) AS DOUBLE) AS q, sum(CASE WHEN y = 1 THEN r ELSE 0 END) AS t FROM r) SELECT round((t - p * (p + 1) / 2) / (p * q), 6) AS value FROM c")
def roc_auc(spark, d):
    x = read(spark, d, "documents").select("doc_id", (F.col("n_chars") % 1000).cast("double").alias("s")).join(read(spark, d, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    return value(K.roc_auc(x, "y", "s"))


@query("mrr_hits", "WITH r AS (SELECT row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) SELECT round(avg(1.0 / k), 6) AS mrr, round(avg(CASE WHEN k <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hits FROM r")
def mrr_hits(spark, d):
    e = read(spark, d, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc_nulls_last("value"), "event_id")))
    return K.mean_reciprocal_rank(e, "k").toDF("mrr").crossJoin(K.hits_at_k(e, "k").toDF("hits")).select(F.round("mrr", 6).alias("mrr"), F.round("hits", 6).alias("hits"))


@query("percentiles", "SELECT round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem")
def percentiles(spark, d):
    values = quantiles(read(spark, d, "lineitem"), F.col("l_extendedprice"), [0.95, 0.99])
    return spark.range(1).select(*[F.round(F.lit(v).cast("double"), 6).alias(n) for n, v in zip(("p95", "p99"), values)])


@query("baselines", "WITH m AS (SELECT l_returnflag AS mode FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT round(avg(l_quantity), 6) AS mean, median(l_quantity) AS median, (SELECT mode FROM m) AS mode FROM lineitem")
def baselines(spark, d):
    li = read(spark, d, "lineitem")
    a, b, c = (learn.baseline(li, t, m) for t, m in (("l_quantity", "meanSquaredError"), ("l_quantity", "meanAbsoluteError"), ("l_returnflag", "f1Macro")))
    return spark.range(1).select(F.round(F.lit(a), 6).alias("mean"), F.lit(b).alias("median"), F.lit(c).alias("mode"))


# Graphs

EDGES = "SELECT DISTINCT o_custkey AS src, l_partkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey"


def ordered_parts(spark, d):
    """src, dst for each row of lineitem."""
    o, li = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("src")), read(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("dst"))
    return spread(o, "o_orderkey", like=li).join(spread(li, "l_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("src", "dst")


def edges(spark, d):
    return distinct(ordered_parts(spark, d))


@query("edge_symmetrize", f"WITH e AS ({EDGES}) SELECT src, dst FROM e UNION SELECT dst, src FROM e")
def edge_symmetrize(spark, d):
    return graph.symmetrize(ordered_parts(spark, d))


@query("degree_norm", f"WITH e AS ({EDGES}), s AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), g AS (SELECT src AS id, count(*) AS n FROM s GROUP BY 1) SELECT src, dst, round(1 / sqrt(a.n * b.n), 6) AS w FROM s JOIN g a ON a.id = src JOIN g b ON b.id = dst")
def degree_norm(spark, d):
    return graph.normalize(graph.symmetrize(ordered_parts(spark, d))).withColumn("w", F.round("w", 6))


@query("adjacency", "SELECT o_custkey AS src, l_partkey AS dst, l_returnflag AS kind, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3")
def adjacency(spark, d):
    e = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("src")).join(read(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("kind")), F.col("l_orderkey") == F.col("o_orderkey"))
    return graph.adjacency(e, kind="kind")


@query("edge_anti", f"WITH e AS ({EDGES}), c AS (SELECT c_custkey AS src, p_partkey AS dst FROM customer, part WHERE c_custkey <= 100 AND p_partkey <= 50) SELECT src, dst FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = c.src AND e.dst = c.dst)")
def edge_anti(spark, d):
    c = read(spark, d, "customer").filter("c_custkey <= 100").select(F.col("c_custkey").alias("src")).crossJoin(read(spark, d, "part").filter("p_partkey <= 50").select(F.col("p_partkey").alias("dst")))
    return graph.edge_difference(c, edges(spark, d), ["src", "dst"])


@query("attach_attributes", "SELECT c_custkey AS id, coalesce(n, 0) AS n, coalesce(s, 0.0) AS s FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def attach_attributes(spark, d):
    a = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s"))
    return graph.attach(read(spark, d, "customer").select(F.col("c_custkey").alias("id")), a)


@query("community_null", "SELECT c_custkey, CAST(-(row_number() OVER (ORDER BY c_custkey) - 1) AS BIGINT) AS community FROM customer")
def community_null(spark, d):
    return graph.community_null(read(spark, d, "customer"), "c_custkey")


@query(
    "best_threshold",
    f"WITH x AS (SELECT y, s / 500 - 1 AS s FROM ({SCORED})), g AS (SELECT i, -1.0::DOUBLE + i * (2.0::DOUBLE / 511) AS t FROM range(512) r(i)), c AS (SELECT i, t, count(*) FILTER ((s > t) = (y = 1)) AS ok FROM g, x GROUP BY 1, 2) SELECT round(t, 6) AS threshold, ok AS \"right\" FROM c ORDER BY ok DESC, i LIMIT 1",
)
def best_threshold(spark, d):
    x = read(spark, d, "documents").select("doc_id", ((F.col("n_chars") % 1000).cast("double") / 500 - 1).alias("s")).join(read(spark, d, "labels"), "doc_id").select("s", (F.col("quality") == 1).alias("y"))
    return graph.best_threshold(x, "s", "y").select(F.round("threshold", 6).alias("threshold"), F.col("right").cast("long").alias("right"))


# Neighbours


@query(
    "knn1",
    "WITH t AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id % 5 <> 0), q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id % 5 = 0 AND vec_id < 1000), p AS (SELECT q.vec_id, t.label, t.vec_id AS neighbour, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, t.v), t.vec_id) AS i FROM q, t) SELECT vec_id, label, neighbour FROM p WHERE i = 1",
)
def knn1(spark, d):
    e = read(spark, d, "embeddings")
    return neighbors.nearest_label(e.filter("vec_id % 5 <> 0"), e.filter("vec_id % 5 = 0 and vec_id < 1000"), "vec_id", "embedding", "label").drop("distance")


@query("band_index", "SELECT p_partkey, CAST(CASE WHEN p_size % 13 IN (0, 10) THEN 0 WHEN p_size % 13 > 10 THEN p_size % 13 - 1 WHEN p_size % 13 = 9 THEN 9 ELSE p_size % 13 - 1 END AS INTEGER) AS band FROM part")
def band_index(spark, d):
    m = F.col("p_size") % 13
    return read(spark, d, "part").select("p_partkey", S.band_index(F.concat(F.lit("0"), F.when(m.isin(0, 10), 1).otherwise(m).cast("string"))).alias("band"))


# Learners: no SQL can express them


@query("forest")
def forest(spark, d):
    e = read(spark, d, "lineitem").filter("l_orderkey % 7 = 0").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    m = learn.Forest(n_estimators=8, max_depth=5).fit(e, "l_returnflag", "id")
    return m.predict(e, "id").select("id", "prediction")


@query("linear_svc")
def linear_svc(spark, d):
    e = read(spark, d, "embeddings").withColumn("y", (F.col("label") % 2).cast("string"))
    e = clean.expand_lists(e.select("vec_id", "embedding", "y"), ["embedding"], widths={"embedding": 8})
    return learn.RankedLinearSVC().fit(e, "y", "vec_id").predict(e, "vec_id")


@query("kmeans")
def kmeans(spark, d):
    e = clean.expand_lists(read(spark, d, "embeddings").select("vec_id", "embedding"), ["embedding"], widths={"embedding": 8})
    return learn.KMeansLabels(4).transform(e, "vec_id")


@query("recommend")
def recommend(spark, d):
    r = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("rating"))
    return learn.Recommender("user_id", "event_type", "rating", (4,), steps=4).fit(r).predict(r.select("user_id", "event_type"))


@query("text_classify")
def text_classify(spark, d):
    x = read(spark, d, "documents").join(read(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("y")), "doc_id")
    return learn.TextClassifier(grid=(0.01,), size=2000).fit(x, "text", "y", "doc_id").predict(x, "doc_id")


@query("link_predict")
def link_predict(spark, d):
    e = edges(spark, d).filter("src <= 200").select(F.col("src").cast("string"), F.concat(F.lit("p"), F.col("dst")).alias("dst"))
    model, ids = graph.factorize_links(e, rank=4, steps=3)
    return graph.score_links(model, ids, e)


@query("negative_edges", "SELECT CAST(100 AS BIGINT) AS n, CAST(100 AS BIGINT) AS kinds, CAST(0 AS BIGINT) AS edges")
def negative_edges(spark, d):
    """How many are drawn, how many of them differ, and how many are edges."""
    e, on = written(edges(spark, d)).withColumn("kind", F.lit("bought")), ["src", "dst", "kind"]
    s = graph.negative_sample(graph.nodes_of(e), e.select("kind"), e, 100)
    known = s.join(e.join(s, on, "left_semi").distinct().withColumn("hit", F.lit(1)), on, "left")
    return known.agg(F.count("*").alias("n"), F.count_distinct("src", "dst", "kind").alias("kinds"), F.count("hit").alias("edges"))


DENSE = "SELECT DISTINCT n_regionkey AS src, n_nationkey % 5 AS dst, CAST(n_nationkey % 2 AS VARCHAR) AS kind FROM nation"


@query("negative_exhaustive", f"WITH e AS ({DENSE}), i AS (SELECT src AS id FROM e UNION SELECT dst FROM e) SELECT a.id AS src, b.id AS dst, k.kind FROM i a, i b, (SELECT DISTINCT kind FROM e) k EXCEPT SELECT src, dst, kind FROM e")
def negative_exhaustive(spark, d):
    """Of a dense graph, more than there are: all places without an edge."""
    n = read(spark, d, "nation")
    e = n.select(F.col("n_regionkey").alias("src"), (F.col("n_nationkey") % 5).cast(n.schema["n_regionkey"].dataType).alias("dst"), (F.col("n_nationkey") % 2).cast("string").alias("kind")).distinct()
    return graph.negative_sample(graph.nodes_of(e), e.select("kind"), e, 1000)


KINDS = "SELECT o_custkey AS src, l_partkey AS dst, l_returnflag AS kind, CAST(sum(l_quantity) AS DOUBLE) AS score FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3"
NORMED = f"SELECT src, dst, kind, score / (sqrt(sum(score * score) OVER (PARTITION BY src, dst)) + 1e-10) AS score FROM ({KINDS})"


def kinds(spark, d):
    e = read(spark, d, "orders").join(read(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return e.groupBy(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("kind")).agg(F.sum("l_quantity").cast("double").alias("score"))


@query("kind_norm", f"SELECT src, dst, kind, round(score, 6) AS score FROM ({NORMED})")
def kind_norm(spark, d):
    return graph.normalize_kinds(kinds(spark, d)).withColumn("score", F.round("score", 6))


@query(
    "gather_links",
    f"WITH s AS ({NORMED}), w AS (SELECT DISTINCT o_custkey AS src, l_partkey AS dst, 'R' AS kind FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1) SELECT src, dst, kind, round(coalesce(score, 0), 6) AS score, coalesce(score, 0) > 0.7 AS linked FROM w LEFT JOIN s USING (src, dst, kind)",
)
def gather_links(spark, d):
    w = read(spark, d, "orders").join(read(spark, d, "lineitem").filter("l_linenumber = 1"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("R").alias("kind")).distinct()
    s = graph.gather(graph.normalize_kinds(kinds(spark, d)), w)
    return s.select("src", "dst", "kind", F.round("score", 6).alias("score"), (F.col("score") > 0.7).alias("linked"))


@query("link_prediction")
def link_prediction(spark, d):
    c = read(spark, d, "customer")
    e = c.select(F.concat(F.lit("n"), F.col("c_nationkey")).alias("src"), F.col("c_mktsegment").alias("dst"), F.when(F.col("c_acctbal") < 0, "debt").otherwise("credit").alias("kind")).distinct()
    return graph.LinkPrediction(rank=4, steps=4, folds=2).fit(e).predict(e)


@query("spectral")
def spectral(spark, d):
    e = read(spark, d, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey")).alias("src"), F.col("c_mktsegment").alias("dst"))
    return graph.spectral(graph.symmetrize(e), 3).select("id", F.size("v").alias("n"))


@query("text_encode")
def text_encode(spark, d):
    x = read(spark, d, "documents").filter("length(text) < 800").join(read(spark, d, "labels"), "doc_id").select("doc_id", "text", "quality")
    return encode.TextEncoder(size=1000).fit(x, ["text"], "quality", "doc_id").transform(x).select("doc_id", "__text_0")


@query("vector_histogram")
def vector_histogram(spark, d):
    return encode.vector_histogram(read(spark, d, "embeddings"), "label", "embedding", k=8)


@query("importances")
def importances(spark, d):
    e = clean.expand_lists(read(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("y")), ["embedding"], widths={"embedding": 6})
    return learn.Forest(n_estimators=4, max_depth=4, num_fits=1).fit(e, "y", "vec_id").importances(e)


@query("contributions")
def contributions(spark, d):
    li = read(spark, d, "lineitem").filter("l_orderkey % 50 = 0").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_discount", F.col("l_extendedprice").alias("y"))
    m = learn.Forest("meanSquaredError", n_estimators=4, max_depth=3, num_fits=1).fit(li, "y", "id")
    return learn.tree_path_contributions(m.models[0], li, "id", m.features)


# More of the relational steps inside the operators


@query("nodes", f"WITH e AS ({EDGES}) SELECT src AS id FROM e UNION SELECT dst FROM e")
def nodes(spark, d):
    return graph.nodes_of(edges(spark, d))


@query("pad_nodes", "SELECT CAST(r_regionkey AS VARCHAR) AS id FROM region UNION ALL SELECT '__pad_' || CAST(i AS VARCHAR) FROM range((SELECT count(*) FROM region), (SELECT count(*) FROM nation)) t(i)")
def pad_nodes(spark, d):
    a, b = (read(spark, d, t).select(F.col(k).cast("string").alias("id")) for t, k in (("region", "r_regionkey"), ("nation", "n_nationkey")))
    return graph.pad_nodes(a, b)[0]


@query("band_filter", "SELECT event_id FROM events WHERE event_type = (SELECT event_type FROM events ORDER BY ts, event_id LIMIT 1)")
def band_filter(spark, d):
    return reshape.band_filter(read(spark, d, "events").select("event_id", "event_type", "ts"), "event_type", ["ts", "event_id"]).select("event_id")


@query("must_match", "SELECT n_nationkey, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def must_match(spark, d):
    n = read(spark, d, "nation").withColumnRenamed("n_regionkey", "k")
    return reshape.must_match(n, read(spark, d, "region").withColumnRenamed("r_regionkey", "k"), "k").select("n_nationkey", "r_name")


@query("top_similar", "WITH s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.embedding[1:4], b.embedding[1:4]) AS s FROM embeddings a, embeddings b WHERE a.vec_id < 60 AND b.vec_id < 60), r AS (SELECT *, rank() OVER (PARTITION BY a ORDER BY round(s, 4) DESC) AS r FROM s) SELECT a, b FROM r WHERE r <= 16 AND a <> b")
def top_similar(spark, d):
    e = read(spark, d, "embeddings").filter("vec_id < 60").select("vec_id", F.slice("embedding", 1, 4).alias("v"))
    s = e.toDF("a", "va").crossJoin(e.toDF("b", "vb")).select("a", "b", F.round(S.dot(F.col("va"), F.col("vb")), 4).alias("s"))
    return neighbors.top_similar(s, "a", "b", "s").select("a", "b")


@query("pair_distances", "SELECT a.vec_id AS query, b.vec_id AS neighbour, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS distance FROM embeddings a, embeddings b WHERE a.vec_id < 20 AND b.vec_id < 50")
def pair_distances(spark, d):
    e = read(spark, d, "embeddings")
    return neighbors.pair_distances(e.filter("vec_id < 20"), e.filter("vec_id < 50"), "vec_id", "embedding", "euclidean").withColumn("distance", F.round("distance", 6))


NATIONS = "WITH e AS (SELECT DISTINCT n_regionkey AS src, n_nationkey + 100 AS dst FROM nation), s AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), g AS (SELECT src AS id, count(*) AS n FROM s GROUP BY 1), a AS (SELECT src, dst, 1 / sqrt(a.n * b.n) AS w FROM s JOIN g a ON a.id = src JOIN g b ON b.id = dst)"


@query(
    "diffuse",
    NATIONS + ", x0 AS (SELECT 0 AS id, 1.0::DOUBLE AS v), x1 AS (SELECT src AS id, 0.9 * sum(w * v) AS v FROM a JOIN x0 ON dst = x0.id GROUP BY 1), x2 AS (SELECT src AS id, 0.9 * sum(w * v) AS v FROM a JOIN x1 ON dst = x1.id GROUP BY 1) SELECT CAST(id AS INTEGER) AS id, round(sum(v), 6) AS value FROM (SELECT * FROM x0 UNION ALL SELECT * FROM x1 UNION ALL SELECT * FROM x2) GROUP BY 1",
)
def diffuse(spark, d):
    e = read(spark, d, "nation").select(F.col("n_regionkey").alias("src"), (F.col("n_nationkey") + 100).alias("dst")).distinct()
    start = spark.range(1).select(F.lit(0).alias("id"), F.lit("x").alias("label"), F.lit(1.0).alias("value"))
    return neighbors.diffuse(graph.normalize(graph.symmetrize(e)), start, 0.9, 2).select("id", F.round("value", 6).alias("value"))


CLASSES = "SELECT quality AS y, CAST(n_chars % 1000 AS DOUBLE) / 1000 AS s FROM documents JOIN labels USING (doc_id)"


@query("roc_auc_micro", f"WITH b AS ({CLASSES}), x AS (SELECT y, s FROM b UNION ALL SELECT 1 - y, 1 - s FROM b), r AS (SELECT y, rank() OVER (ORDER BY round(s, 9)) + (count(*) OVER (PARTITION BY round(s, 9)) - 1) / 2.0 AS r FROM x), c AS (SELECT CAST(sum(y) AS DOUBLE) AS p, CAST(sum(1 - y) AS DOUBLE) AS q, sum(CASE WHEN y = 1 THEN r ELSE 0 END) AS t FROM r) SELECT round((t - p * (p + 1) / 2) / (p * q), 6) AS value FROM c")
def roc_auc_micro(spark, d):
    return value(K.roc_auc_micro(two_classes(spark, d), "y", {1: "s", 0: "t"}))


@query("roc_auc_macro", f"WITH x AS ({CLASSES}), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM x), c AS (SELECT CAST(sum(y) AS DOUBLE) AS p, CAST(sum(1 - y) AS DOUBLE) AS q, sum(CASE WHEN y = 1 THEN r ELSE 0 END) AS t FROM r) SELECT round((t - p * (p + 1) / 2) / (p * q), 6) AS value FROM c")
def roc_auc_macro(spark, d):
    return value(K.roc_auc_macro(two_classes(spark, d), "y", {1: "s", 0: "t"}))


def two_classes(spark, d):
    x = read(spark, d, "documents").select("doc_id", ((F.col("n_chars") % 1000).cast("double") / 1000).alias("s")).join(read(spark, d, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    return x.select("y", F.round("s", 9).alias("s"), F.round(1 - F.col("s"), 9).alias("t"))


@query("class_minimum", "SELECT CAST(greatest(0, least(5, min(n))) AS BIGINT) AS folds FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey)")
def class_minimum(spark, d):
    return spark.range(1).select(F.lit(learn.fold_count(read(spark, d, "customer"), "c_nationkey")).cast("long").alias("folds"))


@query("max_over_frames", "SELECT label, round(max(embedding[1]), 6) AS a, round(max(embedding[2]), 6) AS b FROM embeddings GROUP BY label")
def max_over_frames(spark, d):
    from fernlake.sources.media import max_over_frames as pool

    e = read(spark, d, "embeddings").groupBy("label").agg(F.collect_list(F.slice("embedding", 1, 2)).alias("frames"))
    return pool(e, "label", "frames").select("label", *[F.round(F.col("pooled")[i], 6).alias(n) for i, n in enumerate("ab")])


@query("pair_truncation", "WITH p AS (SELECT doc_id, len(string_split(text, ' ')) AS a, len(string_split(lang || ' ' || source || ' x y z', ' ')) AS b FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(CASE WHEN a + b <= 12 THEN a WHEN b <= 6 THEN 12 - b ELSE 6 END AS BIGINT) AS na, CAST(b AS BIGINT) AS nb FROM p")
def pair_truncation(spark, d):
    x = read(spark, d, "documents").filter("text is not null")
    a, b = S.truncated_pair(F.split("text", " "), F.split(F.concat_ws(" ", "lang", "source", F.lit("x y z")), " "), 12)
    return x.select("doc_id", F.size(a).cast("long").alias("na"), F.size(b).cast("long").alias("nb"))


# Small operators


@query("cast_typed", "SELECT o_orderkey, CAST(o_orderkey AS BIGINT) AS k, CAST(o_totalprice AS DOUBLE) AS price, o_orderkey % 3 <> 0 AS flag FROM orders")
def cast_typed(spark, d):
    from fernlake.sources import dataset

    o = read(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("k"), F.col("o_totalprice").cast("double").cast("string").alias("price"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("yes").alias("flag"))
    return dataset.cast_by_type(M.tag(o, {"k": ("Integer",), "price": ("Float",), "flag": ("Boolean",)}))


@query("split_target", "SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_mktsegment FROM customer")
def split_target(spark, d):
    """Features and target of one table, put together again by key."""
    from fernlake.sources import dataset

    c = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("c_nationkey"), "c_mktsegment")
    x, y = dataset.split_target(M.tag(c, {"c_custkey": ("PrimaryKey",), "c_nationkey": ("Integer", M.ATTRIBUTE), "c_mktsegment": ("SuggestedTarget",)}))
    return x.join(y, "c_custkey")


@query("binary_confidence", "SELECT doc_id, round(CAST(n_chars % 100 AS DOUBLE) / 100, 6) AS b, round(1 - CAST(n_chars % 100 AS DOUBLE) / 100, 6) AS a FROM documents")
def binary_confidence(spark, d):
    x = read(spark, d, "documents").select("doc_id", ((F.col("n_chars") % 100).cast("double") / 100).alias("s")).withColumn("p", F.array(1 - F.col("s"), F.col("s")))
    return x.select("doc_id", F.round(reshape.binary_confidence(F.col("p"), ["a", "b"]), 6).alias("b"), F.round(reshape.binary_confidence(F.col("p"), ["a", "b"], "a"), 6).alias("a"))


@query("roll_up", "SELECT CASE p_brand WHEN 'Brand#11' THEN 'one' WHEN 'Brand#12' THEN 'one' WHEN 'Brand#13' THEN 'two' ELSE p_brand END AS source, CAST(sum(p_size) AS DOUBLE) AS importance FROM part GROUP BY 1")
def roll_up(spark, d):
    return reshape.roll_up(read(spark, d, "part").select(F.col("p_brand").alias("feature"), F.col("p_size").cast("double").alias("importance")), {"Brand#11": "one", "Brand#12": "one", "Brand#13": "two"})


@query("matching", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)")
def matching(spark, d):
    return reshape.matching(read(spark, d, "customer").select("c_custkey"), read(spark, d, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("digits", "SELECT p_partkey, regexp_full_match(CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_name END, '[0-9]+') AS yes FROM part")
def digits(spark, d):
    return read(spark, d, "part").select("p_partkey", S.is_digits(F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_name"))).alias("yes"))


@query("blank_nulls", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END AS p FROM orders")
def blank_nulls(spark, d):
    return M.blank_nulls(read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("p")))


@query("warmup", "SELECT CAST(i AS BIGINT) AS step, round(CASE WHEN i / 200.0 < 0.1 THEN (i / 200.0) / 0.1 ELSE greatest((1 - i / 200.0) / 0.9, 0) END, 6)::DOUBLE AS factor FROM range(260) r(i)")
def warmup(spark, d):
    return spark.range(260).select(F.col("id").alias("step"), F.round(S.warmup(F.col("id"), 0.1, 200), 6).alias("factor"))


@query("same_rows", "SELECT true AS same, false AS other")
def same_rows(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return spark.range(1).select(F.lit(reshape.same_rows(c, c.repartition(3, "c_mktsegment"))).alias("same"), F.lit(reshape.same_rows(c, c.filter("c_custkey <> 7"))).alias("other"))


@query("keyed_prediction", "SELECT doc_id, lang AS label FROM documents")
def keyed_prediction(spark, d):
    return reshape.keyed_prediction(read(spark, d, "documents").select("doc_id", F.col("lang").alias("prediction"), "source"), "doc_id", "prediction", "label")


@query("numeric_projection", "SELECT p_partkey, p_size, p_retailprice, p_name FROM part")
def numeric_projection(spark, d):
    return M.numeric_only(read(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", "p_name", "p_type"), ["p_name"])


@query("replaced_result", "SELECT p_partkey, p_size * 2 AS p_size, p_size AS old FROM part")
def replaced_result(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_size")
    p = clean.return_result(p, {"old": F.col("p_size")}, "append")
    return clean.return_result(p, {"twice": F.col("p_size") * 2}, "replace", replaced={"twice": "p_size"})


@query("stratum_sizes", "SELECT c_mktsegment, CAST(CASE WHEN t <= 100 THEN n ELSE round(n * 100.0 / t) END AS BIGINT) AS n FROM (SELECT c_mktsegment, count(*) AS n, sum(count(*)) OVER () AS t FROM customer GROUP BY 1)")
def stratum_sizes(spark, d):
    return reshape.stratified_sample(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", 100, "c_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("sample_size", "SELECT CAST(100 AS BIGINT) AS n, CAST(100 AS BIGINT) AS known FROM (SELECT 1)")
def sample_size(spark, d):
    """A sample of distinct customers, every one of them in the table."""
    c = read(spark, d, "customer").select("c_custkey")
    return reshape.hashed_sample(c, 100, "c_custkey").join(c, "c_custkey").agg(F.count("*").alias("n"), F.count_distinct("c_custkey").alias("known"))


FAR = {"cityblock": "list_sum(list_transform(range(1, len(x) + 1), lambda i: abs(x[i] - y[i])))", "cosine": "list_cosine_distance(x, y)", "chebyshev": "list_max(list_transform(range(1, len(x) + 1), lambda i: abs(x[i] - y[i])))"}


@query("more_distances", "SELECT query, neighbour, " + ", ".join(f"round({v}, 5) + 0.0 AS {k}" for k, v in FAR.items()) + " FROM (SELECT a.vec_id AS query, b.vec_id AS neighbour, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embeddings a, embeddings b WHERE a.vec_id < 10 AND b.vec_id BETWEEN 10 AND 40)")
def more_distances(spark, d):
    e, out = read(spark, d, "embeddings"), None
    for k in FAR:
        own = neighbors.pair_distances(e.filter("vec_id < 10"), e.filter("vec_id between 10 and 40"), "vec_id", "embedding", k).withColumn(k, F.round("distance", 5) + F.lit(0.0)).drop("distance")
        out = own if out is None else out.join(own, ["query", "neighbour"])
    return out


@query("whiten", "SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS covariance FROM range(3) a(i), range(3) b(j)")
def whiten(spark, d):
    """Covariances of the whitened components of both parts together: the unit matrix."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = read(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("x"))
    a, b = encode.whiten(e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1"), "x", 3)
    w = a.union(b).select(vector_to_array("whitened").alias("w"))
    cov = w.agg(*[F.covar_samp(F.col("w")[i], F.col("w")[j]).alias(f"c{i}{j}") for i in range(3) for j in range(3)])
    return cov.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.round(F.col(f"c{i}{j}"), 6) + F.lit(0.0)).alias("covariance")) for i in range(3) for j in range(3)])).alias("c")).select("c.*")


@query("tfidf_encode")
def tfidf_encode(spark, d):
    x = read(spark, d, "documents").filter("length(text) < 800").select("doc_id", "text")
    return encode.TextEncoder("tfidf", components=4).fit(x, ["text"], key="doc_id").transform(x)
