"""Operator 7: mixing sources to target weights by entropy balancing.

Each document gets a rate r = exp(lambda . f), the token-weighted relative entropy to
"every document once" being the least possible among all rates under which

* every source holds its target share of the token budget, and
* the token-weighted mean length (log of tokens, standardised) of the corpus is what it was, so that
  a source isn't filled up with its longest or shortest documents alone.

The convex dual is solved by distributed Newton iterations: one aggregation a step over the
documents' statistics gives gradient and Hessian, a row for each source, and a line search keeps
the dual falling. The rates are exponentially tilted and are then rounded into whole
copies: the floor, and one more with the probability of the rest, by a hash of the document, so the
same document gets the same copies in every run and the expected tokens are exact.

Target shares default to the sources' shares to the power ``TEMPERATURE``, and the budget
to the corpus's tokens. Tokens are runs without white space, unless ``tokens`` names a column.

Defined results, one row for each input row:
* null source is a source of its own; a target for an absent source is left out and the others scaled up; a source
  without a target (when targets are given) or with target 0 has rate 0 and no copies;
* null or empty text has 0 tokens; it neither counts nor tilts, its length is taken as the mean, and its rate is its source's;
* a source whose documents all have 0 tokens has rate 1; repeated rows and repeated or null doc_id have rates by row, repeated rows the same copies;
* where the documents of each source are all of one length, the sources' shares settle the mean length, and its condition is left out; targets that
  no rates meet raise ``ArithmeticError``; very long texts count as what they are; a row whose hash equals the rest gets no further copy;
* empty tables give empty results; extra columns are ignored by ``rates`` and kept by ``mix``, which keeps column names as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlake.llm.common import cut, pick, table

TEMPERATURE = 0.7
TOLERANCE = 1e-9
MAX_STEPS = 100
#: A source's name where it is null; sources are compared as strings.
NONE = "\0null"
#: Sources up to which their multipliers are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def statistics(docs: DataFrame, tokens: str | None = None) -> DataFrame:
    """doc_id, source, tokens for each row; null sources have a name of their own."""
    if tokens:
        d = pick(docs, "doc_id", "source", tokens).withColumn("tokens", F.greatest(F.coalesce(F.col(tokens), F.lit(0)), F.lit(0)).cast("long"))
    else:
        d = pick(docs, "doc_id", "source", "text").withColumn("tokens", token_count(F.col("text").cast("string")))
    return d.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("source"), "tokens")


def sums(stats: DataFrame, names: np.ndarray, mean: float, sd: float, tilt: float) -> list[np.ndarray]:
    """For each named source the sums of n e^(tilt z), n z e^(tilt z) and n z^2 e^(tilt z), one job over all documents."""
    z = (F.log("tokens") - mean) / sd
    w = F.col("tokens") * F.exp(F.lit(tilt) * z)
    rows = stats.groupBy("source").agg(F.sum(w).alias("a"), F.sum(w * z).alias("b"), F.sum(w * z * z).alias("c")).toArrow().to_pandas().set_index("source")
    return [rows.loc[names, c].to_numpy(float) for c in "abc"]


def solve(stats: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None, temperature: float = TEMPERATURE, tolerance: float = TOLERANCE) -> tuple[dict[str, float], float, float, float]:
    """Multiplier of each source (minus infinity where nothing is wanted), that of the length, and the lengths' mean and deviation.

    The dual of the program is F(l) = sum n exp(l . f) - l . target. Its Hessian is an
    arrow: a diagonal for the sources and one border for the length, so a Newton step needs no more than the sums above.
    """
    full = stats.filter("tokens > 0")
    n = F.col("tokens").cast("double")
    whole = full.groupBy("source").agg(F.sum(n).alias("t"), F.sum(n * F.log("tokens")).alias("s"), F.sum(n * F.log("tokens") * F.log("tokens")).alias("q")).toArrow().to_pandas().set_index("source")
    held = whole["t"].to_dict()
    total = sum(held.values())
    if not total:
        return {}, 0.0, 0.0, 1.0
    wish = targets if targets is not None else {k: (t / total) ** temperature for k, t in held.items()}
    wish = {NONE if k is None else k: max(0.0, float(v)) for k, v in wish.items()}
    wish = {k: v for k, v in wish.items() if v > 0 and k in held}
    if not wish:
        return {k: -np.inf for k in held}, 0.0, 0.0, 1.0
    budget = float(total if budget is None else budget)
    scale = budget / sum(wish.values())
    names = sorted(wish)
    target = np.array([wish[k] * scale for k in names])
    base, s, q = whole.loc[names].sum()
    mean = s / base
    sd = float(np.sqrt(max(q / base - mean**2, 0))) or 1.0
    aim = 0.0  # token-weighted mean of the standardised length, as before

    def at(tilt: float):
        return sums(full, names, mean, sd, tilt)

    tilt = 0.0
    a, b, c = at(tilt)
    lam = np.log(target / a)
    dual = lambda lam, tilt, a: float((np.exp(lam) * a).sum() - lam @ target - tilt * aim)
    value = dual(lam, tilt, a)
    for _ in range(MAX_STEPS):
        e = np.exp(lam)
        grad = np.concatenate([e * a - target, [(e * b).sum() - aim * budget]])
        diagonal, border, corner = e * a, e * b, float((e * c).sum())
        # Schur complement of the arrow; none where the documents of each source are of one length, so that the sources' shares settle the mean
        schur = corner - float((border**2 / diagonal).sum())
        free = schur > 1e-9 * budget
        if np.abs(grad if free else grad[:-1]).max() <= tolerance * budget:
            break
        step_t = -(grad[-1] - float((border * grad[:-1] / diagonal).sum())) / schur if free else 0.0
        step_l = -(grad[:-1] + border * step_t) / diagonal
        size, slope = 1.0, float(grad[:-1] @ step_l + grad[-1] * step_t)
        while True:
            new_t = tilt + size * step_t
            na, nb, nc = at(new_t)
            new_l = lam + size * step_l
            now = dual(new_l, new_t, na)
            if now <= value + 1e-4 * size * slope or size < 1e-6 or abs(slope) < 1e-12 * budget:
                break
            size /= 2
        lam, tilt, a, b, c, value = new_l, new_t, na, nb, nc, now
    else:
        raise ArithmeticError(f"no rates meet the targets within {MAX_STEPS} Newton steps; the remaining error is {np.abs(grad).max() / budget:.3g} of the budget")
    out = {k: -np.inf for k in held} | dict(zip(names, lam.tolist()))
    return out, tilt, mean, sd


def with_rate(df: DataFrame, solution: tuple[dict[str, float], float, float, float], source: Column, tokens: Column, to: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows with the tilted rate; the sources' multipliers are joined, by broadcast up to ``broadcast_rows`` sources."""
    lam, tilt, mean, sd = solution
    z = F.when(tokens > 0, (F.log(F.greatest(tokens, F.lit(1))) - mean) / sd).otherwise(0.0)
    if not lam:
        return df.withColumn(to, F.lit(1.0))
    names = sorted(lam)
    known = df.sparkSession.createDataFrame(pa.table({"__fl_source": names, "__fl_factor": np.exp([lam[k] for k in names])}))
    out = df.join(F.broadcast(known) if len(names) <= broadcast_rows else known, source == F.col("__fl_source"), "left")
    return out.withColumn(to, F.coalesce("__fl_factor", F.lit(1.0)) * F.exp(F.lit(tilt) * z)).drop("__fl_source", "__fl_factor")


def copies_column(rate: Column, seed: int, *identity: Column) -> Column:
    """The floor, and one more if the row's hash, uniform in [0, 1), lies under the rest."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *identity), 11) / F.lit(float(2**53))
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def rates(docs: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None, temperature: float = TEMPERATURE, tokens: str | None = None, seed: int = 5) -> DataFrame:
    """doc_id, source, tokens, rate, copies; one row for each input row."""
    stats = cut(statistics(docs, tokens))
    s = solve(stats, targets, budget, temperature)
    d = with_rate(stats, s, F.col("source"), F.col("tokens"), "rate")
    d = d.withColumn("copies", copies_column(F.col("rate"), seed, F.col("doc_id"), F.col("source"), F.col("tokens")))
    return d.withColumn("source", F.when(F.col("source") != NONE, F.col("source")))


def mix(docs: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None, temperature: float = TEMPERATURE, seed: int = 5) -> DataFrame:
    """The documents, each repeated by its number of copies (none: it leaves), with all their columns.

    Rates and copies follow from a row's own columns, so the texts aren't shuffled.
    """
    s = solve(cut(statistics(docs)), targets, budget, temperature)
    flat = docs.toDF(*[f"__in_{i}" for i in range(len(docs.columns))])
    at = {c: F.col(f"__in_{docs.columns.index(c)}") for c in ("doc_id", "source", "text")}
    source = F.coalesce(at["source"].cast("string"), F.lit(NONE))
    d = flat.withColumn("__fl_tokens", token_count(at["text"].cast("string")))
    d = with_rate(d, s, source, F.col("__fl_tokens"), "__fl_rate")
    d = d.withColumn("__fl_copies", copies_column(F.col("__fl_rate"), seed, at["doc_id"], source, F.col("__fl_tokens")))
    d = d.filter("__fl_copies > 0").withColumn("__fl_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__fl_copies"))))
    return d.select(*flat.columns).toDF(*docs.columns)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, mixed to tempered shares of their sources."""
    return mix(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(table(spark, sf_dir, "documents"))


QUERIES = {"op7_entropy_mix": query}
