"""Datasets described by a JSON document: tables of strings whose fields carry roles and types."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernlake import metadata as M
from fernlake.operators import reshape

DOCUMENT = "datasetDoc.json"


@dataclass
class Dataset:
    """Resources by id, each a frame, and what the document says about those that are collections of files."""

    resources: dict[str, DataFrame]
    collections: dict[str, dict] = field(default_factory=dict)
    root: str = ""

    def main(self) -> tuple[str, DataFrame]:
        if "learningData" in self.resources:
            return "learningData", self.resources["learningData"]
        if len(self.resources) == 1:
            return next(iter(self.resources.items()))
        raise ValueError("no main table")


def read_strings(spark: SparkSession, path: str | list[str], header: bool = True) -> DataFrame:
    """CSV as text only; empty cells are empty strings."""
    return M.blank_nulls(spark.read.csv(path, header=header, inferSchema=False, multiLine=True, escape='"', encoding="UTF-8"))


def load(spark: SparkSession, folder: str) -> Dataset:
    """Read the document in a folder and its tables, lazily; columns the document doesn't name are of type ``UnknownType``."""
    with open(os.path.join(folder, DOCUMENT), encoding="utf-8") as f:
        doc = json.load(f)
    tables, collections = {}, {}
    for r in doc["dataResources"]:
        path = os.path.join(folder, r["resPath"])
        if r.get("isCollection"):
            collections[r["resID"]] = {"path": path, "formats": r.get("resFormat", {}), "columns": r.get("columns", [])}
            continue
        if r.get("resType") not in ("table", None):
            collections[r["resID"]] = {"path": path, "formats": r.get("resFormat", {}), "kind": r.get("resType"), "columns": []}
            continue
        df, said = read_strings(spark, path), {c["colName"]: c for c in r.get("columns", ())}
        for name in df.columns:
            c = said.get(name)
            kinds = {"UnknownType"} if c is None else {M.KINDS.get(c["colType"], c["colType"])} | {t for role in c.get("role", ()) for t in M.ROLES.get(role, (role,))}
            meta = {"semantic_types": sorted(kinds)}
            if c and "refersTo" in c:
                meta["refers_to"] = c["refersTo"]["resID"]
                meta["semantic_types"] = sorted(kinds | {"FileName"})
            if c and "boundary_for" in c:
                meta["boundary_for"] = c["boundary_for"]
            df = df.withMetadata(name, meta)
        tables[r["resID"]] = df
    return Dataset(tables, collections, folder)


def resource(dataset: Dataset, which: str | None = None) -> DataFrame:
    """One table of a dataset; the main one by default."""
    if which is None:
        return dataset.main()[1]
    if which not in dataset.resources:
        raise TypeError(f"resource {which!r} is no table")
    return dataset.resources[which]


def file_column(dataset: Dataset, df: DataFrame, formats: tuple[str, ...] = ("text/csv",)) -> str:
    """The first column that refers to a collection of files of the formats."""
    for f in df.schema:
        target = f.metadata.get("refers_to")
        held = dataset.collections.get(target, {}).get("formats", {})
        if target in dataset.collections and (set(held) & set(formats)):
            return f.name
    raise ValueError("no column refers to files of " + ", ".join(formats))


def format_series(spark: SparkSession, dataset: Dataset, column: str | None = None, equal_length: bool = True) -> DataFrame:
    """Each main row joined to the rows of its file, in long form; files are read by the executors in one scan.

    With ``equal_length`` all series are cut to the shortest. A dataset without a collection is returned as it is.
    """
    _, main = dataset.main()
    if not dataset.collections:
        return main
    column = column or file_column(dataset, main)
    base = dataset.collections[main.schema[column].metadata["refers_to"]]["path"]
    series = spark.read.csv(base, header=True, inferSchema=True)
    names = series.columns
    # a row's place in its file: files are small and not split, so places rise with the row id
    series = series.select("*", F.col("_metadata.file_name").alias("__file"), F.monotonically_increasing_id().alias("__row"))
    small = main.withColumn("__file", F.element_at(F.split(column, "/"), -1))
    out = series.join(small, "__file")
    if equal_length:
        out = reshape.equal_length(out, column, ["__row"], names[0])
    out = out.select(*main.columns, *names, F.col("__row").alias("__order"))
    kinds = {T.DoubleType: "Float", T.IntegerType: "Integer", T.LongType: "Integer"}
    for n in names:
        out = out.withMetadata(n, {"semantic_types": [M.ATTRIBUTE, kinds.get(type(series.schema[n].dataType), "Text")]})
    out = M.retag(out, main)
    out = M.tag(out, {column: M.semantic_types(main, column) | {"GroupingKey"}})
    for k in M.with_role(main, "PrimaryKey"):
        out = M.tag(out, {k: (M.semantic_types(main, k) - {"PrimaryKey"}) | {"PrimaryMultiKey"}})
    return out.orderBy(column, "__order").drop("__order")


def head_share(df: DataFrame, share: float, key: str) -> DataFrame:
    return reshape.prefix(df, share, [key])


def cast_by_type(df: DataFrame) -> DataFrame:
    """Strict casts by semantic type: a bad number fails; any text that isn't empty is true."""
    out = {}
    for f in df.schema:
        kinds = M.semantic_types(df, f.name)
        if "Integer" in kinds:
            out[f.name] = F.col(f.name).cast("long")
        elif "Float" in kinds:
            out[f.name] = F.col(f.name).cast("double")
        elif "Boolean" in kinds:
            out[f.name] = F.length(F.col(f.name)) > 0
    return M.retag(df.withColumns(out), df) if out else df


def split_target(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features (typed) and target with the key, by roles; the suggested target counts where no true one is named."""
    target = M.with_role(df, "TrueTarget") or M.with_role(df, "Target") or M.with_role(df, "SuggestedTarget")
    keys = M.with_role(df, "PrimaryKey", "PrimaryMultiKey")
    return cast_by_type(df.drop(*target)), df.select(*keys, *target)


def accepts(df: DataFrame, required: dict[str, str]) -> bool:
    """Whether a frame has the columns with the simple type names required."""
    return all(c in df.columns and df.schema[c].dataType.simpleString() == t for c, t in required.items())


# Graphs


def read_edge_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a CSV whose first column is a row index: two ends, and an attribute where there is a third."""
    e = read_strings(spark, path)
    _, src, dst, *more = e.columns
    edges = e.select(F.col(src).alias("src"), F.col(dst).alias("dst"), *[F.col(c).alias("attribute" if i == 0 else c) for i, c in enumerate(more)])
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), edges


def gml_tokens(text: str):
    import re

    for m in re.finditer(r'"((?:[^"\\]|\\.)*)"|([\[\]])|([^\s\[\]"#]+)|#[^\n]*', text):
        if m[1] is not None:
            yield "text", m[1]
        elif m[2]:
            yield "mark", m[2]
        elif m[3]:
            yield "word", m[3]


def parse_gml(text: str) -> tuple[list[dict], list[dict]]:
    """Nodes and edges of a GML text, as attribute dictionaries."""

    def scalar(kind, v):
        if kind == "text":
            return v
        for f in (int, float):
            try:
                return f(v)
            except ValueError:
                pass
        return v

    def block(tokens):
        out = []
        for kind, v in tokens:
            if (kind, v) == ("mark", "]"):
                return out
            k2, v2 = next(tokens)
            out.append((v, block(tokens) if (k2, v2) == ("mark", "[") else scalar(k2, v2)))
        return out

    graph = next((v for k, v in block(gml_tokens(text)) if k == "graph"), [])
    return [dict(v) for k, v in graph if k == "node"], [dict(v) for k, v in graph if k == "edge"]


def read_gml(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of GML files, read by the executors; ids as text, other attributes as a map of texts, ``file`` says which graph."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")

    def table(which: int, keys: tuple[str, ...]):
        def run(batches):
            import pandas as pd

            for b in batches:
                rows = []
                for name, text in zip(b["file"], b["value"]):
                    for item in parse_gml(text)[which]:
                        rows.append((name, *[str(item[k]) for k in keys], {k: str(v) for k, v in item.items() if k not in keys}))
                yield pd.DataFrame(rows, columns=["file", *keys, "attributes"])

        return run

    nodes = files.mapInPandas(table(0, ("id",)), "file string, id string, attributes map<string,string>")
    edges = files.mapInPandas(table(1, ("source", "target")), "file string, source string, target string, attributes map<string,string>")
    return nodes, edges.withColumnsRenamed({"source": "src", "target": "dst"})


def number_of(c: Column) -> Column:
    return c.cast("string").try_cast("double")
