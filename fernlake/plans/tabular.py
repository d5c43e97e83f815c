"""The tabular plan: parse, enrich, impute, fold, encode, learn, predict."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from fernlake import metadata as M
from fernlake.operators import clean, encode, learn


@dataclass
class TabularPlan:
    """Prepares a described table and runs a forest on it. ``prepare`` fits on its first frame and replays on later ones."""

    target: str
    key: str
    metric: str = "f1Macro"
    max_one_hot: int = 16
    imputer: clean.Imputer | None = None
    steps: list = field(default_factory=list)
    learner: learn.Forest | None = None

    def _parsed(self, df: DataFrame) -> DataFrame:
        return clean.parse_columns(M.blank_nulls(df), ("Integer", "Float", "FloatVector"), exclude_columns=[self.target], key=self.key)

    def prepare(self, df: DataFrame) -> DataFrame:
        x = clean.enrich_dates(self._parsed(df))
        if self.imputer is None:
            self.imputer = clean.Imputer().fit(x)
        x = self.imputer.transform(x)
        if not self.steps:
            one = encode.OneHotEncoder(self.max_one_hot).fit(x)
            two = encode.BinaryEncoder(self.max_one_hot + 1).fit(x)
            self.steps = [one, two]
        for s in self.steps:
            x = s.transform(x)
        return x

    def fit(self, df: DataFrame, **options) -> TabularPlan:
        x = self.prepare(df)
        self.learner = learn.Forest(metric=self.metric, **options).fit(x, self.target, self.key)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return self.learner.predict(self.prepare(df), self.key)
