"""Operator 1: quality rules, learned as an ordered decision list.

Sequential covering in the manner of RIPPER/IREP: a rule is a conjunction of
thresholds on text statistics, grown by FOIL gain on two thirds of the labelled
rows, pruned on the other third, and kept while the pruned rule is right more
often than wrong there. The list is emitted as one ordered ``CASE WHEN`` built
of Spark expressions, so applying it is a projection in generated JVM code: no
shuffle, no Python.

Defined results:
* null or empty text (or only white space): rejected by the rule ``empty``;
* a document that no rule covers, as well as every document when there are no
  labels or labels of one class only, is kept (``rule_id`` -1);
* null or other labels than 0 and 1 are ignored; a document labelled both ways counts once each way;
* repeated rows and repeated or null ``doc_id``: each row gets its own result row; at most ``MAX_LABELLED`` rows teach, also where doc_ids repeat;
* very long texts are counted whole; ties: of equal gains the first statistic, direction and lowest threshold is taken, of equally good prunings the shorter
  rule, and a statistic equal to a threshold is "at least" it; where several rules hold, the first decides;
* empty tables give empty results; extra columns are ignored by ``decide`` and kept by ``stage``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlake.llm.common import pick, table

#: Labelled rows that the list is learned from at most, chosen by hash of doc_id.
MAX_LABELLED = 20_000


#: Share of characters that match, by name. Counting matches stays in generated code; ``translate`` makes a string for each character.
SHARES = {"upper": r"\p{Lu}", "bangs": r"[!?]", "pipes": r"[|<>{}\[\]\\]", "symbols": r"[#$%&*+=@^_~]", "digits": r"[0-9]", "stops": r"[.,;:]", "line_breaks": r"\n"}
NAMES = ("n_words", "word_chars", "type_token", "repeated_words", *SHARES)


def with_statistics(df: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    """The rows with a column ``__fl_<name>`` for each named statistic of ``text``; numbers for any text, null included.

    The text is split into words once, in a projection of its own that the others
    refer to, so that generated code doesn't repeat the split for each statistic.
    """
    t = F.coalesce("text", F.lit(""))
    df = df.withColumn("__fl_words", F.array_remove(F.split(t, r"\s+"), ""))
    df = df.withColumns({"__fl_n": F.size("__fl_words").cast("double"), "__fl_types": F.size(F.array_distinct("__fl_words"))})
    n, chars = F.greatest("__fl_n", F.lit(1.0)), F.greatest(F.length(t), F.lit(1)).cast("double")
    stats = {
        "n_words": F.col("__fl_n"),
        "word_chars": F.length(t) / n,
        # Herdan's measure: unlike the share of distinct words it hardly falls with the length of a text
        "type_token": F.when(F.col("__fl_n") < 2, 1.0).otherwise(F.log("__fl_types") / F.log(n)),
        "repeated_words": F.regexp_count(t, F.lit(r"(?<!\S)(\S+)(?=\s+\1(?!\S))")) / n,
    } | {k: F.regexp_count(t, F.lit(v)) / chars for k, v in SHARES.items()}
    return df.withColumns({f"__fl_{k}": stats[k] for k in names}).drop("__fl_words", "__fl_types", *(() if "n" in names else ("__fl_n",)))


@dataclass(frozen=True)
class Rule:
    """Reject where all conditions (statistic, at_least, threshold) hold."""

    conditions: tuple[tuple[str, bool, float], ...]

    def __str__(self) -> str:
        return " and ".join(f"{name} {'>=' if up else '<'} {at:.6g}" for name, up, at in self.conditions)

    def covers(self, names: list[str], x: np.ndarray) -> np.ndarray:
        hit = np.ones(len(x), bool)
        for name, up, at in self.conditions:
            v = x[:, names.index(name)]
            hit &= (v >= at) if up else (v < at)
        return hit

    def column(self) -> Column:
        out = F.lit(True)
        for name, up, at in self.conditions:
            v = F.col(f"__fl_{name}")
            out = out & ((v >= at) if up else (v < at))
        return out


def grow(names: list[str], x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], most: int) -> list[tuple[str, bool, float]]:
    """Add the condition of the best FOIL gain until only positives are left or nothing gains."""
    inside, out = np.ones(len(y), bool), []
    while len(out) < most:
        p0, n0 = int(y[inside].sum()), int((~y[inside]).sum())
        if not p0 or not n0:
            break
        base, best, chosen = np.log2(p0 / (p0 + n0)), 1e-9, None
        for j, name in enumerate(names):
            v, pos = x[inside, j], y[inside]
            at = np.searchsorted(cuts[j], v, side="right")  # how many cuts are <= v
            ps = np.bincount(at[pos], minlength=len(cuts[j]) + 1)
            ns = np.bincount(at[~pos], minlength=len(cuts[j]) + 1)
            for up in (True, False):
                p = ps[::-1].cumsum()[::-1][1:] if up else ps.cumsum()[:-1]
                n = ns[::-1].cumsum()[::-1][1:] if up else ns.cumsum()[:-1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), 0)
                if len(gain) and gain.max() > best:
                    best, k = float(gain.max()), int(gain.argmax())
                    chosen = (name, up, float(cuts[j][k]))
        if chosen is None:
            break
        out.append(chosen)
        inside &= Rule((chosen,)).covers(names, x)
    return out


def prune(names: list[str], x: np.ndarray, y: np.ndarray, conditions: list[tuple[str, bool, float]]) -> tuple[list, float, int]:
    """The prefix of the conditions with the best (p - n) / (p + n) on the pruning rows; its precision and coverage."""
    best: tuple[float, int, float, int] = (-2.0, len(conditions), 0.0, 0)
    for k in range(len(conditions), 0, -1):
        hit = Rule(tuple(conditions[:k])).covers(names, x)
        p, n = int((hit & y).sum()), int((hit & ~y).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth >= best[0]:
            best = (worth, k, p / (p + n) if p + n else 0.0, p + n)
    return conditions[: best[1]], best[2], best[3]


def learn(names: list[str], x: np.ndarray, bad: np.ndarray, min_precision: float = 0.8, max_rules: int = 24, max_conditions: int = 4, n_cuts: int = 128, min_cover: int = 3, seed: int = 7) -> list[Rule]:
    """Ordered rules that reject; rows covered by a rule leave before the next is learned."""
    rules: list[Rule] = []
    bad = bad.astype(bool)
    while len(rules) < max_rules and bad.any() and not bad.all():
        held = np.zeros(len(bad), bool)  # a third of each class, spread evenly
        for c in (True, False):
            held[np.flatnonzero(bad == c)[(seed + len(rules)) % 3 :: 3]] = True
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_cuts + 1)[1:])) for j in range(len(names))]
        mids = [np.unique(np.concatenate([c, np.quantile(x[bad, j], np.linspace(0, 1, 33))])) for j, c in enumerate(cuts)]
        grown = grow(names, x[~held], bad[~held], mids, max_conditions)
        if not grown:
            break
        pruned, precision, cover = prune(names, x[held], bad[held], grown)
        if precision < min_precision or cover < min_cover:
            break
        rule = Rule(tuple(pruned))
        hit = rule.covers(names, x)
        rules.append(rule)
        x, bad = x[~hit], bad[~hit]
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, **options) -> list[Rule]:
    """Learn the list from at most ``max_labelled`` labelled rows (the lowest hashes of doc_id).

    The chosen labels are bounded by that parameter, so they are broadcast and
    the documents are neither shuffled nor collected: only the statistics of
    labelled documents reach the driver.
    """
    lab = pick(labels, "doc_id", "quality").filter("doc_id is not null and quality in (0, 1)").distinct()
    lab = lab.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labelled)
    d = pick(docs, "doc_id", "text").filter(~blank(F.col("text"))).join(F.broadcast(lab), "doc_id")
    rows = with_statistics(d).select("doc_id", "quality", *[F.col(f"__fl_{k}").alias(k) for k in NAMES])
    # a doc_id that stands for many rows doesn't bring more than that either
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", *NAMES).limit(max_labelled).toPandas()
    if not len(rows):
        return []
    names = list(NAMES)
    rows = rows.sort_values(["doc_id", "quality", *names], kind="stable")
    return learn(names, rows[names].to_numpy(float), rows["quality"].to_numpy() == 0, **options)


def blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"\S")


def with_rule(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows with ``__fl_rule``: the ordered conditional expression, number of the first rule that holds."""
    used = tuple(k for k in NAMES if any(k == c[0] for r in rules for c in r.conditions))
    first = F.when(blank(F.col("text")), 0)
    for i, r in enumerate(rules, 1):
        first = first.when(r.column(), i)
    df = with_statistics(df, used).withColumn("__fl_rule", first.otherwise(-1))
    return df.drop(*[f"__fl_{k}" for k in used])


def decide(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, rule_id, rule, keep; one row for each input row."""
    d = with_rule(pick(docs, "doc_id", "text"), rules).select("doc_id", F.col("__fl_rule").alias("rule_id"))
    wording = F.element_at(F.array(*[F.lit(x) for x in ("keep", "empty", *map(str, rules))]), F.col("rule_id") + 2)
    return d.select("doc_id", "rule_id", wording.alias("rule"), (F.col("rule_id") == -1).alias("keep"))


def keep(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that no rule rejects, with all their columns, whatever they are called."""
    flat = docs.toDF(*[f"__in_{i}" for i in range(len(docs.columns))])
    flat = with_rule(flat.withColumn("text", F.col(f"__in_{docs.columns.index('text')}")), rules).filter("__fl_rule = -1")
    return flat.select(*[f"__in_{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return keep(docs, fit(docs, table(spark, sf_dir, "labels")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return decide(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op1_quality_rules": query}
