"""Operators on small frames with known results."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernlake import catalog
from fernlake import metadata as M
from fernlake import registry
from fernlake.functions import metrics as K
from fernlake.functions import scalar as S
from fernlake.operators import clean, encode, graph, learn, neighbors, reshape
from fernlake.plans import parts
from fernlake.plans.ordered import quantiles
from fernlake.plans.tabular import TabularPlan
from fernlake.sources import dataset, media
from fernlake.streaming import transform_stream

ROWS = [("1", "whiskey", "whiskey", "whiskey", ""), ("2", "whiskey", "xray", "whiskey", ""), ("3", "", "", "whiskey", ""), ("4", "whiskey", "yankee", "whiskey", ""), ("5", "yankee", "zulu", "whiskey", "")]
CATEGORIES = ["alpha", "bravo", "charlie", "delta"]


@pytest.fixture
def table(spark):
    df = spark.createDataFrame(ROWS, "row string, alpha string, bravo string, charlie string, delta string")
    return M.tag(df, {c: ("CategoricalData", M.ATTRIBUTE) for c in CATEGORIES} | {"row": ("Integer", "PrimaryKey")})


def test_impute(table):
    out = {r["row"]: r for r in clean.Imputer().fit(table).transform(table).collect()}
    assert [out["3"][c] for c in CATEGORIES] == ["whiskey", "whiskey", "whiskey", M.MISSING]
    assert M.semantic_types(clean.Imputer().fit(table).transform(table), "alpha") == {"CategoricalData", M.ATTRIBUTE}
    with pytest.raises(ValueError):
        clean.Imputer(error_on_empty=True).fit(table)
    state = clean.Imputer().fit(table).get_params()
    assert clean.Imputer().set_params(state).transform(table).count() == 5


def test_singletons(table):
    out = {r["row"]: r["alpha"] for r in clean.replace_singletons(table, ["alpha"]).collect()}
    assert out["5"] == M.SINGLETON and out["1"] == "whiskey" and out["3"] == M.SINGLETON


def test_one_hot_and_binary(table):
    x = encode.OneHotEncoder().fit(table).transform(table)
    assert [c for c in x.columns if c.startswith("__onehot")] == [f"__onehot_{i}" for i in range(10)]
    assert M.source_column(x, "__onehot_0") == "alpha"
    b = encode.BinaryEncoder(min_binary=3).fit(table)
    y = b.transform(table)
    assert sum(c.startswith("__binary") for c in y.columns) == 5 and "charlie" in y.columns and "alpha" not in y.columns
    codes = {tuple(r[f"__binary_{i}"] for i in range(2, 5)) for r in y.collect()}
    assert len(codes) == 5


def test_one_hot_unseen_and_null(spark):
    a = spark.createDataFrame([("x",), ("y",)], "c string")
    b = spark.createDataFrame([("z",), (None,)], "c string")
    assert [tuple(r) for r in encode.OneHotEncoder().fit(a, ["c"]).transform(b).collect()] == [(0.0, 0.0), (0.0, 0.0)]


def test_parse(spark):
    df = spark.createDataFrame([("1", "1", "0.5", "1", "s", "1"), ("2", "2", "1d", "0", "t", "")], "k string, c string, f string, b string, t string, n string")
    df = M.tag(df, {"k": ("Integer",), "c": ("CategoricalData",), "f": ("Float",), "b": ("Boolean",), "t": ("Text",), "n": ("Integer",)})
    out = clean.parse_columns(df, key="k")
    assert [t for _, t in out.dtypes] == ["bigint", "bigint", "double", "bigint", "string", "double"]
    assert out.filter("k = 2").first()["f"] is None
    assert dict(clean.parse_columns(df, errors="ignore").dtypes)["f"] == "string"
    with pytest.raises(ValueError):
        clean.parse_columns(df, errors="raise")
    assert dict(clean.parse_columns(df, use_columns=["k"], exclude_columns=["k"]).dtypes)["k"] == "bigint"


def test_vectors_dates_lists(spark):
    df = M.tag(spark.createDataFrame([("1,2", "2019-01-21 10:54:21"), ("70,80", "Jan 21 2019 10:54:21")], "v string, d string"), {"v": ("FloatVector",), "d": ("DateTime", M.ATTRIBUTE)})
    out = clean.parse_columns(df)
    assert [r["d"] for r in out.collect()] == [1548068061.0] * 2
    assert [r["v"] for r in clean.parse_columns(out).collect()] == [[1.0, 2.0], [70.0, 80.0]]
    wide = clean.expand_lists(out.select("v"))
    assert wide.columns == ["v_0", "v_1"] and wide.collect()[1]["v_1"] == 80.0
    assert "__date_0" not in clean.enrich_dates(df).columns  # one date only: no deviation


def test_text_encoder(spark):
    rows = [(i, f"{w} common words here {w}", y) for i, (w, y) in enumerate([("red", 0), ("blue", 1), ("blue", 1), ("red", 0), ("blue", 1), ("green", 2), ("green", 2), ("red", 0), ("green", 2)])]
    df = spark.createDataFrame(rows, "id int, t string, y int")
    assert [c for c in encode.TextEncoder().fit(df, ["t"], "y", "id").transform(df).columns if c.startswith("__text")] == ["__text_0", "__text_1", "__text_2"]
    two = df.filter("y < 2")
    assert [c for c in encode.TextEncoder().fit(two, ["t"], "y", "id").transform(two).columns if c.startswith("__text")] == ["__text_0"]
    with pytest.raises(ValueError):
        encode.TextEncoder().fit(df.filter("y < 2 or id = 5"), ["t"], "y", "id")


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.4), (0, 0, 0.1)], "a int, p int, s double")
    assert K.evaluate(df, "accuracy", "a", "p") == 0.75
    assert K.evaluate(df, "f1", "a", "p") == pytest.approx(2 / 3)
    assert K.roc_auc(df, "a", "s").first()[0] == pytest.approx(0.875)
    assert K.evaluate(df, "normalizedMutualInformation", "a", "a") == pytest.approx(1)
    assert sorted(r["rank"] for r in K.average_rank(df, "s").collect()) == [1, 2.5, 2.5, 4]
    assert K.translate("rocAucMicro") == "roc_auc_micro"
    assert K.evaluate(df.limit(0), "accuracy", "a", "p") is None


def test_vote_and_confidences(spark):
    v = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (2, "a", 2), (2, "a", 3), (2, "b", 4)], "row int, label string, o int")
    assert {r["row"]: r["label"] for r in reshape.majority_vote(v, "row", "label", "o").collect()} == {1: "b", 2: "a"}
    assert reshape.equal_length(v, "row", ["o"], "label").count() == 4
    assert reshape.same_rows(v, v.orderBy(F.desc("o"))) and not reshape.same_rows(v, v.limit(2))


def test_graphs(spark, tmp_path):
    (tmp_path / "g.gml").write_text('graph [ node [ id 1 label "a" ] node [ id 2 label "b" ] edge [ source 1 target 2 weight 2.5 ] ]')
    nodes, edges = dataset.read_gml(spark, str(tmp_path / "g.gml"))
    assert sorted(r["id"] for r in nodes.collect()) == ["1", "2"] and edges.first()["attributes"]["weight"] == "2.5"
    (tmp_path / "e.csv").write_text(",s,t,kind\n0,a,b,x\n1,b,c,y\n")
    n, e = dataset.read_edge_list(spark, str(tmp_path / "e.csv"))
    assert n.count() == 3 and e.columns == ["src", "dst", "attribute"]
    kinds = e.withColumnRenamed("attribute", "kind")
    neg = graph.negative_sample(n, kinds.select("kind"), kinds, 5)
    assert 0 < neg.count() <= 5 and neg.join(kinds, ["src", "dst", "kind"]).count() == 0
    a = np.array([[0, 1, 0, 0], [1, 0, 1, 1], [0, 1, 0, 0], [0, 1, 0, 0]], float)
    p = np.array([2, 0, 3, 1])
    b = np.zeros_like(a)
    b[np.ix_(p, p)] = a
    got = graph.match_seeded(a, b, [(0, 2)])
    assert got[1] == 0
    sp = graph.spectral(graph.symmetrize(e), 2)
    assert sp.count() == 3
    model, ids = graph.factorize_links(e, rank=2, steps=2)
    assert graph.score_links(model, ids, e.select("src", "dst")).count() == 2


def series(tmp_path):
    (tmp_path / "tables").mkdir()
    (tmp_path / "series").mkdir()
    (tmp_path / "tables/main.csv").write_text("row,file,label\n0,a.csv,x\n1,b.csv,y\n")
    (tmp_path / "series/a.csv").write_text("time,value\n1,10\n2,20\n3,30\n")
    (tmp_path / "series/b.csv").write_text("time,value\n1,5\n2,6\n")
    doc = {"dataResources": [
        {"resID": "0", "resPath": "series", "resType": "timeseries", "isCollection": True, "resFormat": {"text/csv": ["csv"]}},
        {"resID": "learningData", "resPath": "tables/main.csv", "resType": "table", "columns": [{"colIndex": 0, "colName": "row", "colType": "integer", "role": ["index"]}, {"colIndex": 1, "colName": "file", "colType": "string", "role": ["attribute"], "refersTo": {"resID": "0"}}]},
    ]}
    (tmp_path / dataset.DOCUMENT).write_text(json.dumps(doc))
    return str(tmp_path)


def test_series(spark, tmp_path):
    ds = dataset.load(spark, series(tmp_path))
    assert M.semantic_types(dataset.resource(ds), "label") == {"UnknownType"}
    out = dataset.format_series(spark, ds)
    assert out.columns == ["row", "file", "label", "time", "value"] and out.count() == 4
    assert "GroupingKey" in M.semantic_types(out, "file") and "PrimaryMultiKey" in M.semantic_types(out, "row")
    assert dataset.format_series(spark, ds, equal_length=False).count() == 5
    with pytest.raises(TypeError):
        dataset.resource(ds, "0")


def test_media(spark, tmp_path):
    import wave

    with wave.open(str(tmp_path / "a.wav"), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(100)
        f.writeframes(np.arange(150, dtype="<i2").tobytes())
    rows = spark.createDataFrame([("a.wav", "0.5,0.7"), ("a.wav", "")], "filename string, span string")
    got = {r["span"]: r["audio"] for r in media.read_audio(spark, str(tmp_path), rows, span="span").collect()}
    assert len(got["0.5,0.7"]["samples"]) == 100 and got["0.5,0.7"]["samples"][:2] == [50, 51] and len(got[""]["samples"]) == 150
    x = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    assert (media.decompress(media.compress(x)) == x).all()
    assert media.resample(np.ones((3, 5)), 4).shape == (4, 4)


def test_scalars(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5], [6, 7])], "a array<int>, b array<int>")
    r = df.select(*[c.alias(n) for n, c in S.pair_features(F.col("a"), F.col("b"), 5).items()]).first()
    assert len(r["ids"]) == 5 and sum(r["mask"]) == 5 and r["segments"] == [0, 0, 0, 1, 1]
    with pytest.raises(Exception, match="unknown band"):
        spark.createDataFrame([("10",)], "b string").select(S.band_index(F.col("b"))).collect()
    assert neighbors.dtw([1, 2, 3], [1, 2, 2, 3]) == 0


def test_plan_and_learners(spark):
    rows = [(str(i), "hot" if i % 2 else "cold", str(i % 7), "yes" if i % 2 else "no") for i in range(60)]
    df = M.tag(spark.createDataFrame(rows, "row string, temp string, n string, y string"), {"row": ("Integer", "PrimaryKey"), "temp": ("CategoricalData", M.ATTRIBUTE), "n": ("Integer", M.ATTRIBUTE), "y": ("TrueTarget",)})
    plan = TabularPlan("y", "row").fit(df, n_estimators=4)
    p = plan.predict(df)
    assert p.join(df.select(F.col("row").cast("long").alias("row"), "y"), "row").filter("prediction != y").count() == 0
    imp = {r["source"]: r["importance"] for r in plan.learner.importances(plan.prepare(df)).collect()}
    assert imp["temp"] > imp["n"]
    assert plan.learner.confidences(plan.prepare(df), "row").count() == 60
    assert learn.fold_count(df, "y") == 5


def test_stream(spark, table, tmp_path):
    table.write.parquet(str(tmp_path / "in"))
    enc = encode.OneHotEncoder().fit(table)
    q = transform_stream(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), enc).writeStream.format("memory").queryName("hot").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from hot").count() == 5


def test_registry():
    assert registry.parameters("one_hot")["max_one_hot"] == 16 and "forest" in json.loads(registry.describe())
    f = registry.timed(lambda: 3)
    assert f() == 3 and f.seconds >= 0


def test_remaining(spark):
    a = spark.createDataFrame([(1, [0.0, 0.0], "x"), (2, [1.0, 1.0], "y")], "id long, v array<double>, y string")
    q = spark.createDataFrame([(9, [0.9, 1.0])], "id long, v array<double>")
    for metric in ("euclidean", "cityblock"):
        assert neighbors.nearest_label(a, q, "id", "v", "y", metric).first()["label"] == "y"
    g = graph.normalize(graph.symmetrize(spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")))
    d = neighbors.diffuse(g, spark.createDataFrame([("a", "L", 1.0)], "id string, label string, value double"), terms=3)
    assert {r["id"] for r in d.collect()} == {"a", "b", "c"}
    r = spark.createDataFrame([("u", "i", 3.0), ("v", "i", 1.0)], "u string, i string, r double")
    out = learn.Recommender("u", "i", "r", (2,), steps=2).fit(r).predict(spark.createDataFrame([("new", "i")], "u string, i string")).first()
    assert out["prediction"] == pytest.approx(2.0)
    e = reshape.must_match(a, spark.createDataFrame([(1, 5)], "id long, n int"), "id")
    with pytest.raises(Exception, match="no match"):
        e.collect()


def test_persist(spark, table, tmp_path):
    from fernlake.plans import persist

    for made, empty in ((encode.OneHotEncoder().fit(table), encode.OneHotEncoder()), (encode.BinaryEncoder(min_binary=3).fit(table), encode.BinaryEncoder()), (clean.Imputer().fit(table), clean.Imputer())):
        persist.save(made, str(tmp_path / type(made).__name__))
        again = persist.load(empty, str(tmp_path / type(made).__name__))
        assert sorted(map(str, again.transform(table).collect())) == sorted(map(str, made.transform(table).collect()))
    rows = spark.createDataFrame([(i, float(i % 5), "a" if i % 5 < 2 else "b") for i in range(50)], "id long, x double, y string")
    forest = learn.Forest(n_estimators=2, num_fits=1).fit(rows, "y", "id", ["x"])
    persist.save(forest, str(tmp_path / "forest"))
    again = persist.load(learn.Forest(), str(tmp_path / "forest"))
    assert again.predict(rows, "id").join(rows, "id").filter("prediction != y").count() == 0


def test_biases():
    from fernlake.operators.adjust import class_biases, f1_macro

    rng = np.random.default_rng(0)
    y = (rng.random(400) < 0.1).astype(int)
    s = np.column_stack([np.full(400, 0.6), 0.4 * y + 0.3 * rng.random(400)])
    assert f1_macro(y, (s + class_biases(s, y)).argmax(axis=1), 2) >= f1_macro(y, s.argmax(axis=1), 2)


def test_quantiles(spark):
    rows = [(float(x * 37 % 101),) for x in range(500)] + [(None,), (-3.5,), (7.25,)]
    df, at = spark.createDataFrame(rows, "x double").repartition(5), [0.0, 0.013, 0.5, 0.95, 0.99, 1.0]
    assert quantiles(df, F.col("x"), at) == list(df.agg(*[F.percentile("x", q) for q in at]).first())
    assert quantiles(df.filter("x is null"), F.col("x"), [0.5]) == [None]
    assert quantiles(df.limit(1).select(F.lit(2).alias("x")), F.col("x"), [0.3]) == [2.0]


@pytest.mark.parametrize("name", ["percentiles", "token_median", "baselines"])
def test_no_task_holds_all_values(spark, monkeypatch, name):
    """The aggregate ``percentile`` brings all distinct values into one task."""
    monkeypatch.setattr(F, "percentile", lambda *a: pytest.fail("percentile"))
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() == 1


def test_symmetrize_nulls_and_loops(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (None, 4), (5, None), (None, None), (1, 2), (4, None)], "src long, dst long")
    want = {(1, 2), (2, 1), (3, 3), (None, 4), (4, None), (5, None), (None, 5), (None, None)}
    got = [tuple(r) for r in graph.symmetrize(e).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("name", ["edge_symmetrize", "degree_norm", "edge_anti"])
def test_distinct_edges_take_parts_by_input(spark, monkeypatch, name):
    """Distinct edges are found in as many tasks as the input asks for, whatever the session's number of shuffle partitions."""
    monkeypatch.setattr(parts.parts_of, "__defaults__", (20_000,))
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    numbers = [int(x) for x in re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert numbers and max(numbers) > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_negative_edges_find_edges_once(spark, monkeypatch):
    """The join behind the edges is planned once, and what is drawn is read back, not drawn again by every reader."""
    made = []
    monkeypatch.setattr(catalog, "distinct", lambda df: made.append(df) or df.select("src", "dst").distinct())
    out = catalog.QUERIES["negative_edges"](spark, "/root/testdata/sf0.001")
    read = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(made) == 1 and "parquet" in read and "o_custkey" not in read and "l_partkey" not in read
    assert tuple(out.first()) == (100, 100, 0)


@pytest.mark.parametrize("size", [3, 12, 1000])
def test_vocabulary_is_the_most_frequent_grams(spark, monkeypatch, size):
    from collections import Counter

    from pyspark.ml.feature import CountVectorizer

    rng = np.random.default_rng(5)
    texts = [[f"w{min(int(x), 60)}" for x in rng.geometric(0.12, int(rng.integers(0, 40)))] for _ in range(60)] + [[]]
    n = Counter(" ".join(t[i : i + k]) for t in texts for k in (1, 2, 3) for i in range(len(t) - k + 1))
    df = spark.createDataFrame([(t,) for t in texts], "w array<string>")
    assert encode.vocabulary(df, F.col("w"), 3, size) == sorted(n, key=lambda g: (-n[g], g))[:size]
    # CountVectorizer shuffles every gram there is
    monkeypatch.setattr(CountVectorizer, "fit", lambda *a: pytest.fail("all grams are counted"))
    rows = spark.createDataFrame([(" ".join(t),) for t in texts], "t string")
    assert encode.tfidf(rows, "t", 2, size).transform(rows).count() == 61
