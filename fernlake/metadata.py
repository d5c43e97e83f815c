"""Semantic types of columns, kept in field metadata, and the rule by which operators choose their columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATTRIBUTE = "Attribute"
CATEGORICALS = frozenset(("CategoricalData", "OrdinalData", "DateTime", "Boolean"))
ROLES = {
    "index": ("PrimaryKey",),
    "multiIndex": ("PrimaryMultiKey",),
    "attribute": (ATTRIBUTE,),
    "suggestedTarget": ("SuggestedTarget", ATTRIBUTE),
    "suggestedGroupingKey": ("SuggestedGroupingKey", ATTRIBUTE),
    "timeIndicator": ("Time", ATTRIBUTE),
    "boundaryIndicator": ("Boundary",),
}
KINDS = {"integer": "Integer", "real": "Float", "string": "Text", "categorical": "CategoricalData", "ordinal": "OrdinalData", "dateTime": "DateTime", "boolean": "Boolean", "realVector": "FloatVector"}
MISSING = "__missing_5be0f9a1__"
SINGLETON = "__singleton_2c71d6e4__"


def semantic_types(df: DataFrame, column: str) -> frozenset[str]:
    return frozenset(df.schema[column].metadata.get("semantic_types", ()))


def source_column(df: DataFrame, column: str) -> str:
    """The column that a derived one stems from; the column itself where it stems from none."""
    return df.schema[column].metadata.get("source_column", column)


def tag(df: DataFrame, types: dict[str, Iterable[str]], **more) -> DataFrame:
    """The frame with the semantic types of the named columns set; a change of metadata only, the plan stays one projection."""
    for c, kinds in types.items():
        meta = dict(df.schema[c].metadata) | {"semantic_types": sorted(set(kinds))} | more
        df = df.withMetadata(c, meta)
    return df


def retag(df: DataFrame, like: DataFrame) -> DataFrame:
    """Give columns the metadata they have in another frame; for after an expression, which drops it."""
    for f in like.schema:
        if f.metadata and f.name in df.columns and not df.schema[f.name].metadata:
            df = df.withMetadata(f.name, f.metadata)
    return df


def operating_columns(df: DataFrame, use_columns: Iterable[str] | None, types: Iterable[str], require_attribute: bool = True) -> list[str]:
    """Columns with any of the types, in the frame's order; ``use_columns``, if not empty, narrows them and never widens."""
    types, use = frozenset(types), set(use_columns or ())
    out = []
    for c in df.columns:
        own = semantic_types(df, c)
        if own & types and (not require_attribute or ATTRIBUTE in own) and (not use or c in use):
            out.append(c)
    return out


def structural_columns(df: DataFrame, use_columns: Iterable[str] | None, kinds: tuple[type, ...], require_attribute: bool = True) -> list[str]:
    use = set(use_columns or ())
    return [f.name for f in df.schema if isinstance(f.dataType, kinds) and (not require_attribute or ATTRIBUTE in semantic_types(df, f.name)) and (not use or f.name in use)]


def usable_columns(df: DataFrame, use_columns: Iterable[str] | None, exclude_columns: Iterable[str] | None) -> list[str]:
    """``exclude_columns`` counts only where ``use_columns`` isn't given."""
    if use_columns:
        return [c for c in df.columns if c in set(use_columns)]
    return [c for c in df.columns if c not in set(exclude_columns or ())]


def with_role(df: DataFrame, *roles: str) -> list[str]:
    return [c for c in df.columns if semantic_types(df, c) & set(roles)]


def numeric_only(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Only numeric columns and those named."""
    keep = set(keep)
    return df.select(*[f.name for f in df.schema if isinstance(f.dataType, T.NumericType) or f.name in keep])


def blank_nulls(df: DataFrame) -> DataFrame:
    """Null strings become empty, which is what missing text looks like here; metadata stays."""
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return retag(df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in strings}), df) if strings else df
