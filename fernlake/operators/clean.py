"""Parsing, imputing and reshaping of columns, as projections and single aggregations."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernlake import metadata as M

NUMBER = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"
DATE_PATTERNS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy", "M/d/yyyy", "MMM d yyyy HH:mm:ss", "MMM d yyyy", "d MMM yyyy", "MMM d, yyyy", "yyyy-MM", "yyyy",
)


def to_number(c: Column) -> Column:
    """Double of a numeric text, null for any other; unlike a cast it refuses the suffixes d and f."""
    c = c.cast("string")
    return F.when(c.rlike(NUMBER), F.expr("1D") * F.trim(c).try_cast("double"))


def to_vector(c: Column) -> Column:
    """Doubles of a text of numbers between commas."""
    return F.transform(F.split(c, ","), lambda x: F.trim(x).try_cast("double"))


def to_time(c: Column) -> Column:
    """The first of the known date patterns that fits, as a timestamp without zone."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(p)) for p in DATE_PATTERNS]).cast("timestamp_ntz")


def to_epoch(c: Column, fuzzy: bool = True) -> Column:
    """Seconds since 1970 of a date in text; what no pattern fits goes to a tolerant parser, in Arrow batches."""
    known = F.unix_micros(to_time(c).cast("timestamp")) / F.lit(1e6)
    return F.coalesce(known, _fuzzy()(F.when(known.isNull(), c))) if fuzzy else known


def _fuzzy():
    @F.pandas_udf("double")
    def fuzzy(s: pd.Series) -> pd.Series:
        from datetime import timezone

        from dateutil import parser

        def one(x):
            try:
                return parser.parse(x, fuzzy=True).replace(tzinfo=timezone.utc).timestamp() if x else None
            except (ValueError, OverflowError, TypeError):
                return None

        return s.map(one).astype("float64")

    return fuzzy


def parse_columns(df: DataFrame, parsing: Iterable[str] = ("Boolean", "CategoricalData", "Integer", "Float", "FloatVector", "DateTime"), use_columns=None, exclude_columns=None, errors: str = "coerce", fuzzy_dates: bool = True, key: str | None = None) -> DataFrame:
    """Parse string columns by semantic type.

    Integers, floats and booleans become numbers: ``long`` if all are whole and none is
    missing, else ``double`` (one aggregation answers that for all columns). Categories become numbers if the first value (in the order
    of ``key``) has only digits. ``errors``: coerce to null, ``ignore`` (a column with a bad value stays text) or ``raise``.
    """
    if errors not in ("coerce", "ignore", "raise"):
        raise ValueError(errors)
    wanted, picked = set(parsing), M.usable_columns(df, use_columns, exclude_columns)
    strings = [c for c in picked if isinstance(df.schema[c].dataType, T.StringType)]
    kind = {c: M.semantic_types(df, c) & wanted for c in strings}
    category = [c for c in strings if "CategoricalData" in kind[c] and not kind[c] & {"Integer", "Float"}]
    numbers = [c for c in strings if kind[c] & {"Integer", "Float", "Boolean"}]
    if category:
        order = F.col(key) if key else F.monotonically_increasing_id()
        first = df.select(*category, order.alias("__order")).agg(*[F.min_by(c, "__order").alias(c) for c in category]).first()
        numbers += [c for c in category if first[c] is not None and first[c].isascii() and first[c].isdigit() and c not in numbers]
    out: dict[str, Column] = {}
    if numbers:
        n = {c: to_number(F.col(c)) for c in numbers}
        checks = [x for c in numbers for x in (
            F.bool_and(n[c].isNotNull() & ~F.isnan(n[c]) & (F.abs(n[c]) < 9e15) & (n[c] == F.floor(n[c]))).alias(f"{c}\0whole"),
            F.count_if(n[c].isNull() & (F.coalesce(F.col(c), F.lit("")) != "")).alias(f"{c}\0bad"),
        )]
        seen = df.agg(*checks).first()
        for c in numbers:
            if seen[f"{c}\0bad"] and errors == "raise":
                raise ValueError(f"column {c!r} holds {seen[f'{c}\0bad']} values that aren't numbers")
            if seen[f"{c}\0bad"] and errors == "ignore":
                continue
            whole = seen[f"{c}\0whole"] and "Float" not in kind[c]
            out[c] = n[c].cast("long") if whole else n[c]
    out |= {c: to_vector(F.col(c)) for c in strings if "FloatVector" in kind[c]}
    out |= {c: to_epoch(F.col(c), fuzzy_dates) for c in strings if "DateTime" in kind[c]}
    return M.retag(df.withColumns(out), df) if out else df


def replace_singletons(df: DataFrame, use_columns: Iterable[str] | None = None, token: str = M.SINGLETON, columns: Iterable[str] | None = None) -> DataFrame:
    """Values of categorical columns that occur once become the token; nulls stay.

    One aggregation for each column finds the values that occur more than once, and a left join marks the others, so a frequent
    value isn't a hot partition as it would be in a window.
    """
    cols = list(columns) if columns is not None else M.operating_columns(df, use_columns, M.CATEGORICALS)
    out = df
    for i, c in enumerate(cols):
        often = df.groupBy(F.col(c).alias(f"__v{i}")).count().filter("count > 1").select(f"__v{i}")
        out = out.join(often, F.col(c) == F.col(f"__v{i}"), "left")
        out = out.withColumn(c, F.when(F.col(c).isNotNull() & F.col(f"__v{i}").isNull(), F.lit(token)).otherwise(F.col(c))).drop(f"__v{i}")
    return M.retag(out, df)


class Imputer:
    """Blanks of categorical columns become the most frequent value (the least of equals) or a constant."""

    def __init__(self, strategy: str = "most_frequent", fill_value: str = M.MISSING, error_on_empty: bool = False, use_columns=None):
        if strategy not in ("most_frequent", "constant"):
            raise ValueError(strategy)
        self.strategy, self.fill_value, self.error_on_empty, self.use_columns = strategy, fill_value, error_on_empty, use_columns
        self.values: dict[str, str] | None = None

    def fit(self, df: DataFrame, columns: Iterable[str] | None = None) -> Imputer:
        cols = list(columns) if columns is not None else M.operating_columns(df, self.use_columns, M.CATEGORICALS)
        if self.strategy == "constant" or not cols:
            self.values = dict.fromkeys(cols, self.fill_value)
            return self
        row = df.agg(*[F.mode(F.nullif(F.col(c), F.lit("")), True).alias(c) for c in cols]).first()
        if self.error_on_empty and any(row[c] is None for c in cols):
            raise ValueError("a column has no values")
        self.values = {c: self.fill_value if row[c] is None else row[c] for c in cols}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.values:
            return df
        return M.retag(df.withColumns({c: F.when(F.col(c) == "", F.lit(v)).otherwise(F.col(c)) for c, v in self.values.items()}), df)

    def get_params(self) -> dict:
        return dict(vars(self))

    def set_params(self, params: dict) -> Imputer:
        vars(self).update(params)
        return self


def enrich_dates(df: DataFrame, use_columns: Iterable[str] | None = None, replace: bool = False, columns: Iterable[str] | None = None) -> DataFrame:
    """Standardised seconds since 2000-01-01 (population deviation), appended as ``__date_i`` or in place.

    All columns' means and deviations come from one aggregation. Text that isn't a date makes the whole column null; a
    column of one date gives 0 in place, and no new column.
    """
    cols = list(columns) if columns is not None else M.operating_columns(df, use_columns, ("DateTime",))
    if not cols:
        return df
    secs = {c: (F.unix_micros((to_time(F.col(c)) if isinstance(df.schema[c].dataType, T.StringType) else F.col(c)).cast("timestamp")) / F.lit(1e6) - F.lit(946684800.0)) for c in cols}
    stats = df.agg(*[x for i, c in enumerate(cols) for x in (F.avg(secs[c]).alias(f"m{i}"), F.stddev_pop(secs[c]).alias(f"s{i}"), F.count_if(secs[c].isNull()).alias(f"n{i}"))]).first()
    out, number = {}, 0
    for i, c in enumerate(cols):
        if stats[f"m{i}"] is None:  # nothing in it is a date
            continue
        flat = not stats[f"s{i}"]
        if flat and not replace:
            continue
        z = F.lit(None).cast("double") if stats[f"n{i}"] else F.lit(0.0) if flat else (secs[c] - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"])
        name = c if replace else f"__date_{number}"
        out[name], number = z, number + 1
    sources = [c for i, c in enumerate(cols) if stats[f"m{i}"] is not None and (replace or stats[f"s{i}"])]
    done = M.retag(df.withColumns(out), df) if out else df
    return M.tag(done, {n: ("Float", M.ATTRIBUTE) for n in out}, **{}) if replace or not out else _lineage(done, dict(zip(out, sources)))


def _lineage(df: DataFrame, of: dict[str, str]) -> DataFrame:
    for name, source in of.items():
        df = df.withMetadata(name, {"semantic_types": ["Attribute", "Float"], "source_column": source})
    return df


def expand_lists(df: DataFrame, columns: Iterable[str] | None = None, use_columns: Iterable[str] | None = None, widths: dict[str, int] | None = None) -> DataFrame:
    """Array columns become ``<name>_<i>``, null past a row's end; the array goes."""
    cols = list(columns) if columns is not None else M.structural_columns(df, use_columns, (T.ArrayType,), require_attribute=False)
    if not cols:
        return df
    if widths is None:
        row = df.agg(*[F.max(F.size(c)).alias(c) for c in cols]).first()
        widths = {c: max(row[c] or 0, 0) for c in cols}
    new = {f"{c}_{i}": F.get(F.col(c), F.lit(i)) for c in cols for i in range(widths[c])}
    out = df.withColumns(new).drop(*cols)
    return _lineage(out, {f"{c}_{i}": c for c in cols for i in range(widths[c])})


def drop_incomplete(df: DataFrame, target: str, features: Iterable[str]) -> DataFrame:
    """Rows with a blank target, then rows with a null or NaN feature, go; features and target stay in one frame."""
    out = df.filter(F.col(target).isNotNull())
    if isinstance(df.schema[target].dataType, T.StringType):
        out = out.filter(F.col(target) != "")
    return out.dropna(subset=list(features))


def scale(df: DataFrame, columns: Iterable[str], how: str = "standardize") -> DataFrame:
    """Standardise columns by population deviation (constant columns are centred), or scale rows to unit length."""
    cols = list(columns)
    if how == "unit_norm":
        norm = F.sqrt(sum((F.col(c).cast("double") * F.col(c) for c in cols), F.lit(0.0)))
        return M.retag(df.withColumn("__norm", norm).withColumns({c: F.when(F.col("__norm") > 0, F.col(c) / F.col("__norm")).otherwise(F.col(c).cast("double")) for c in cols}).drop("__norm"), df)
    if how != "standardize":
        raise ValueError(how)
    row = df.agg(*[x for i, c in enumerate(cols) for x in (F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"))]).first()
    return M.retag(df.withColumns({c: (F.col(c) - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"] or 1.0) for i, c in enumerate(cols)}), df)


def return_result(df: DataFrame, new: dict[str, Column], how: str = "new", keys: Iterable[str] = (), replaced: dict[str, str] | None = None) -> DataFrame:
    """Merge derived columns: ``append`` them, ``replace`` the columns they stem from, or return keys and ``new`` ones only."""
    if how == "append":
        return df.withColumns(new)
    if how == "replace":
        return M.retag(df.withColumns({(replaced or {}).get(n, n): c for n, c in new.items()}), df)
    if how == "new":
        return df.select(*keys, *[c.alias(n) for n, c in new.items()])
    raise ValueError(how)


def reassign_boundaries(df: DataFrame, old: str, new: str) -> DataFrame:
    """Columns that bound ``old`` come to bound ``new``; metadata only."""
    for f in df.schema:
        if f.metadata.get("boundary_for") == old:
            df = df.withMetadata(f.name, dict(f.metadata) | {"boundary_for": new})
    return df

