"""Saving and loading of fitted operators: plain state as JSON, tables as Parquet, Spark models in their own format."""

from __future__ import annotations

import json

from pyspark.ml.util import DefaultParamsReader, MLWritable
from pyspark.sql import DataFrame, SparkSession


def save(fitted, folder: str) -> None:
    """Write an operator's state below a folder of any file system Spark reaches."""
    state, spark = fitted.get_params(), SparkSession.getActiveSession()

    def put(x, at: str):
        if isinstance(x, DataFrame):
            x.write.mode("overwrite").parquet(f"{folder}/{at}")
            return {"table": at}
        if isinstance(x, MLWritable):
            x.write().overwrite().save(f"{folder}/{at}")
            return {"model": at}
        if isinstance(x, dict):
            return {"map": [[k, put(v, f"{at}/{i}")] for i, (k, v) in enumerate(x.items())]}
        if isinstance(x, (list, tuple)):
            return {"list": [put(v, f"{at}/{i}") for i, v in enumerate(x)], "tuple": isinstance(x, tuple)}
        return {"value": x}

    text = json.dumps({k: put(v, k) for k, v in state.items()})
    spark.createDataFrame([(text,)], "state string").coalesce(1).write.mode("overwrite").text(f"{folder}/state")


def load(empty, folder: str):
    """Fill a new operator of the same class with saved state."""
    spark = SparkSession.getActiveSession()

    def get(x):
        (kind, v), *_ = x.items()
        if kind == "table":
            return spark.read.parquet(f"{folder}/{v}")
        if kind == "model":
            return DefaultParamsReader.loadParamsInstance(f"{folder}/{v}", spark)
        if kind == "map":
            return {k: get(y) for k, y in v}
        if kind == "list":
            return (tuple if x["tuple"] else list)(get(y) for y in v)
        return v

    state = json.loads(spark.read.text(f"{folder}/state").first()[0])
    return empty.set_params({k: get(v) for k, v in state.items()})
