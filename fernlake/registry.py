"""Operators by name, their parameters with defaults, and small diagnostics."""

from __future__ import annotations

import functools
import inspect
import json
import time

from fernlake.operators import clean, encode, graph, learn, neighbors, reshape
from fernlake.plans.tabular import TabularPlan
from fernlake.sources import dataset, media

OPERATORS = {
    "load_dataset": dataset.load, "format_series": dataset.format_series, "load_edge_list": dataset.read_edge_list, "load_graphs": dataset.read_gml, "load_audio": media.read_audio, "load_bands": media.stack_bands,
    "parse_columns": clean.parse_columns, "replace_singletons": clean.replace_singletons, "impute_categories": clean.Imputer, "enrich_dates": clean.enrich_dates, "expand_lists": clean.expand_lists,
    "one_hot": encode.OneHotEncoder, "binary": encode.BinaryEncoder, "text": encode.TextEncoder, "forest": learn.Forest, "ranked_linear_svc": learn.RankedLinearSVC, "k_means": learn.KMeansLabels,
    "text_classifier": learn.TextClassifier, "collaborative_filtering": learn.Recommender, "community_detection": graph.community_null, "link_prediction": graph.factorize_links, "seeded_matching": graph.match_seeded,
    "spectral_features": graph.spectral, "nearest_label": neighbors.nearest_label, "diffuse": neighbors.diffuse, "majority_vote": reshape.majority_vote, "tabular": TabularPlan,
}


def parameters(name: str) -> dict:
    """Names and defaults of an operator's parameters; those without a default are absent."""
    return {k: p.default for k, p in inspect.signature(OPERATORS[name]).parameters.items() if p.default is not inspect.Parameter.empty and not callable(p.default)}


def describe() -> str:
    """All operators with their parameters, as JSON."""
    return json.dumps({k: {"doc": (inspect.getdoc(v) or "").split("\n")[0], "parameters": {n: repr(d) for n, d in parameters(k).items()}} for k, v in OPERATORS.items()}, indent=1)


def timed(f):
    """The function, with the seconds of its last call in ``f.seconds``; its value comes through."""

    @functools.wraps(f)
    def g(*a, **k):
        began = time.perf_counter()
        try:
            return f(*a, **k)
        finally:
            g.seconds = time.perf_counter() - began

    g.seconds = None
    return g
