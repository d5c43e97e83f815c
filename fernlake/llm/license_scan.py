"""Operator 6: licence scans by ordered signature rules.

Hundreds of hand-written regular expressions (``license_rules.TABLE``), each
gated by a keyword: the longest literal that any match must contain, derived
from the parsed expression so the gate never loses a match. One Aho-Corasick
pass over the lower-cased text tells which expressions can match at all; only
those are run, over the whole text. Overlaps are resolved by priority and
interval containment: a detection inside another of the same or a higher
priority goes, and so does one that a higher priority overlaps; of detections
of one interval and priority, the first in the table stays.

It is a projection in Arrow batches without a shuffle.

Defined results: null and empty texts have no detections; each detection is one
row, in order of position; repeated rows and repeated or null doc_id give
detections for every row; empty tables give empty results; extra columns are
ignored, whatever they are called. Offsets count Unicode code points; letters match without regard to
ASCII case. Very long texts are scanned whole; detections are resolved in one sweep for each priority.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlake.llm.common import pick, table
from fernlake.llm.license_rules import TABLE

GAP = r"[\s*#/;%\-]+"


def literals(tree) -> list[str]:
    """Runs of literal characters that every match of a parsed expression contains."""
    from re import _constants as k

    runs, run = [], ""
    for op, arg in tree:
        if op is k.LITERAL:
            run += chr(arg)
            continue
        if run:
            runs.append(run)
        run = ""
        if op is k.SUBPATTERN:
            runs += literals(arg[3])
        elif op in (k.MAX_REPEAT, k.MIN_REPEAT) and arg[0] > 0:
            runs += literals(arg[2])
    return runs + ([run] if run else [])


@lru_cache(maxsize=1)
def rules():
    """(licence, priority, compiled expression, keyword) in table order."""
    from re import _parser

    out = []
    for line in TABLE.strip().splitlines():
        name, priority, expression = (x.strip() for x in line.split(" | ", 2))
        expression = expression.replace(" ?", f"(?:{GAP})?").replace(" ", GAP)
        flags = re.IGNORECASE | re.ASCII
        keyword = max(literals(_parser.parse(expression, flags)), key=len)
        out.append((name, int(priority), re.compile(expression, flags), keyword.lower()))
    return out


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    by: dict[str, list[int]] = {}
    for i, r in enumerate(rules()):
        by.setdefault(r[3], []).append(i)
    a = ahocorasick.Automaton()
    for keyword, which in by.items():
        a.add_word(keyword, which)
    a.make_automaton()
    return a


def resolve(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of (start, end, priority, rule), those that no stronger detection contains or overlaps, by position."""
    kept: list[tuple[int, int, int, int]] = []
    starts: list[int] = []  # of the merged stretches that stronger detections cover, and their ends
    ends: list[int] = []
    for _, group in groupby(sorted(set(found), key=lambda d: (-d[2], d[0], -d[1], d[3])), key=lambda d: d[2]):
        last, new = -1, []
        for d in group:
            at = bisect_left(starts, d[1]) - 1
            if (at < 0 or ends[at] <= d[0]) and d[1] > last:  # by start, so what contains it came before
                new.append(d)
                last = d[1]
        kept += new
        merged: list[list[int]] = []
        for a, b in sorted([*zip(starts, ends), *((d[0], d[1]) for d in new)]):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        starts, ends = [m[0] for m in merged], [m[1] for m in merged]
    return sorted(kept)


def detect(text: str | None) -> list[tuple[int, int, int, int]]:
    """(start, end, priority, rule number) of each detection in a text."""
    if not text:
        return []
    gated: set[int] = set()
    seen: set[int] = set()
    for _, which in automaton().iter(text.lower()):
        if id(which) not in seen:
            seen.add(id(which))
            gated.update(which)
    if not gated:
        return []
    table_ = rules()
    return resolve([(m.start(), m.end(), table_[i][1], i) for i in gated for m in table_[i][2].finditer(text)])


def _detections():
    @F.pandas_udf("array<struct<license:string,rule_id:int,priority:int,start:int,end:int>>")
    def detections(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([[(rules()[i][0], i, p, a, b) for a, b, p, i in detect(t)] for t in batch], dtype=object)

    return detections


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, license, rule_id, priority, start, end; one row for each detection."""
    d = pick(docs, "doc_id", "text").filter("text is not null")
    return d.select("doc_id", F.explode(_detections()("text")).alias("hit")).select("doc_id", "hit.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op6_license_scan": query}
