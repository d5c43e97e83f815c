"""Operator 5: quality classifier by an interpolated modified Kneser-Ney model.

A character n-gram model of order ``ORDER`` for each language is trained on trusted
text (documents labelled of good quality). Counts, continuation counts, discounts (three for each
order, from counts of counts) and interpolation weights are Spark aggregations and joins, sharded
by n-gram. Documents are dealt to chunks of one language and about ``CHUNK_BYTES``, the one shuffle of the
texts, in compressed blocks; a chunk's n-grams are counted where it lies, and its distinct n-grams are joined with the model's,
which come back to the chunk and meet its texts. So the model is never collected or broadcast, and may be of any size.

A document's perplexity for each character decides: it is kept up to its
language's threshold, the ``QUANTILE`` of the perplexities of the trusted documents that
were held out of training (a tenth, by hash of doc_id).

An n-gram is its characters' numbers of 16 bits side by side, so contexts and suffixes are shifts and masks of it; the characters
beyond the basic plane share the 6,400 numbers of its private area. Runs of white space count as one space, and a
text begins with ``ORDER`` - 1 marks of its start. Characters never seen share the part of the probability that
interpolation leaves for one unknown character.

Defined results, one row for each input row:
* null or empty text (or only white space): perplexity null, not kept;
* null lang is a language of its own; a language without trusted text: perplexity null, kept (there is nothing to hold it against);
* null doc_id: scored like others, but never trusted; a doc_id labelled both good and bad isn't trusted;
* repeated rows give a row each and count once each in training; empty tables give empty results; extra columns are ignored, whatever they are called;
* very long texts are scored whole, in stretches of ``STRETCH`` characters; equal perplexities are decided alike, and one equal to the threshold is kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlake.llm.common import cut, packed, pick, release, table, unpacked

ORDER = 4
CHUNK_BYTES = 48_000_000
QUANTILE = 0.99
HELD_OUT = 10
START = 0xFFFF  # not a character
#: Characters that are worked on at once: each takes some 60 bytes then.
STRETCH = 400_000


def stretches(texts: Iterable[str | None], order: int = ORDER, most: int = STRETCH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Character numbers, the places where the texts' own characters are, and the number of the text at each of these places.

    Memory follows characters, not texts: short texts come together up to about ``most`` characters, each after its marks
    of the start, and a longer text comes in parts, each after the ``order`` - 1 characters before it.
    """
    head = np.full(order - 1, START, np.uint32)
    parts, own_, n = [], [], 0

    def done():
        p = np.concatenate(parts)
        high = p > 0xFFFF
        if high.any():
            p[high] = 0xE000 + p[high] * np.uint32(2654435761) % np.uint32(6400)
        return p, np.concatenate([np.arange(s, e) for _, s, e in own_]), np.repeat([i for i, _, _ in own_], [e - s for _, s, e in own_])

    for i, t in enumerate(texts):
        own = np.frombuffer(" ".join((t or "").split()).encode("utf-32-le", "surrogatepass"), np.uint32)
        for s in range(0, len(own), most):
            part = own[s : s + most]
            parts += [own[s - order + 1 : s] if s else head, part]
            own_.append((i, n + order - 1, n + order - 1 + len(part)))
            n += order - 1 + len(part)
            if n >= most:
                yield done()
                parts, own_, n = [], [], 0
    if own_:
        yield done()


def merged(ks: list[np.ndarray], ns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in order, and the sums of their counts."""
    k, n = np.concatenate(ks), np.concatenate(ns)
    order = np.argsort(k, kind="stable")
    k = k[order]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[starts], np.add.reduceat(n[order], starts)


def keys(p: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """For n = 1 to order, the n-gram that ends at each place, the newest character lowest. Valid from place n - 1 on."""
    out = [p.astype(np.uint64)]
    for n in range(1, order):
        k = out[-1].copy()
        k[n:] |= out[0][:-n] << np.uint64(16 * n)
        out.append(k)
    return [k.view(np.int64) for k in out]


def distinct_places(k: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the places the number of its n-gram, and for each number the first place."""
    codes, kinds = pd.factorize(k[at])
    first = np.zeros(len(kinds), np.int64)
    first[codes[::-1]] = np.arange(len(at))[::-1]
    return codes, at[first]


def highest_counts(rows: DataFrame, good: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, k (n-gram of the highest order), n: counts over the trusted documents, summed up for each chunk before they are shuffled."""

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        trusted, lang = set(right.column("doc_id").to_pylist()), None
        ks, ns, size = [], [], 0
        for block in left.column("block") if trusted else ():
            t = unpacked(block.as_py())
            lang = t.column("lang")[0].as_py()
            for p, at, _ in stretches((x.as_py() for i, x in zip(t.column("doc_id").to_pylist(), t.column("text")) if i in trusted), order):
                k, n = np.unique(keys(p, order)[-1][at], return_counts=True)
                ks, ns, size = [*ks, k], [*ns, n], size + len(k)
                if size > 2 * len(ks[0]) + STRETCH:
                    k, n = merged(ks, ns)
                    ks, ns, size = [k], [n], len(k)
        k, n = merged(ks, ns) if ks else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        release()
        return pa.table({"lang": pa.array([lang] * len(k), pa.string()), "k": pa.array(k, pa.int64()), "n": pa.array(n, pa.int64())})

    counted = rows.groupBy("chunk").cogroup(good.groupBy("chunk")).applyInArrow(count, "lang string, k long, n long")
    return counted.groupBy("lang", "k").agg(F.sum("n").alias("n"))


def suffix(k: str, n: int):
    """The last n characters of an n-gram column."""
    return F.col(k).bitwiseAND(F.lit((1 << 16 * n) - 1 if n < 4 else -1).cast("long"))


def train(top: DataFrame, order: int = ORDER) -> DataFrame:
    """The model: lang, n, key, p (probability of a seen n-gram), g (weight that a seen context gives the lower order).

    ``top`` has the counts of the highest order. The context of order 0 has n = 0 and key 0; its ``p`` is the probability of an unknown character.
    """
    model, lower, longer = [], None, None
    by_order = {order: cut(top.select("lang", "k", F.col("n").alias("c")))}
    for n in range(order - 1, 0, -1):  # distinct continuations to the left of the next longer
        longer = by_order[n + 1]
        by_order[n] = cut(longer.groupBy("lang", suffix("k", n).alias("k")).agg(F.count("*").alias("c")))
    for n in range(1, order + 1):
        counts = by_order[n].withColumn("context", F.shiftrightunsigned("k", 16) if n > 1 else F.lit(0).cast("long"))
        of = [F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

        def discount(k: int):
            d = F.when((F.col(f"n{k}") > 0) & (F.col("n1") > 0), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"))
            return F.when(d.isNotNull(), F.least(F.greatest(d, F.lit(0.05 * k)), F.lit(0.95 * k))).otherwise(0.5 * k).alias(f"d{k}")

        discounts = counts.groupBy("lang").agg(*of).select(F.col("lang").alias("l"), *[discount(k) for k in (1, 2, 3)])
        d = counts.join(F.broadcast(discounts), F.col("lang").eqNullSafe(F.col("l"))).drop("l")  # three numbers for each language
        d = d.withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        contexts = cut(d.groupBy("lang", "context").agg(F.sum("c").cast("double").alias("total"), F.sum("d").alias("left"), F.count("*").alias("kinds")))
        g = F.col("left") / F.col("total")
        d = d.join(contexts.withColumnsRenamed({"lang": "l", "context": "x"}), F.col("lang").eqNullSafe(F.col("l")) & (F.col("context") == F.col("x"))).drop("l", "x")
        if n == 1:
            unknown = g / (F.col("kinds") + 1)
            grams = d.select("lang", F.col("k").alias("key"), ((F.col("c") - F.col("d")) / F.col("total") + unknown).alias("p"))
            model.append(contexts.select("lang", F.lit(0).alias("n"), F.lit(0).cast("long").alias("key"), unknown.alias("p"), F.lit(1.0).alias("g")))
        else:
            d = d.withColumn("g", g).withColumn("s", suffix("k", n - 1)).join(lower.select(F.col("lang").alias("l"), F.col("key").alias("s"), F.col("p").alias("q")).withColumnRenamed("s", "x"), F.col("lang").eqNullSafe(F.col("l")) & (F.col("s") == F.col("x")))
            grams = d.select("lang", F.col("k").alias("key"), ((F.col("c") - F.col("d")) / F.col("total") + F.col("g") * F.col("q")).alias("p"))
            model.append(contexts.select("lang", F.lit(n - 1).alias("n"), F.col("context").alias("key"), F.lit(None).cast("double").alias("p"), g.alias("g")))
        lower = cut(grams)
        model.append(lower.select("lang", F.lit(n).alias("n"), "key", "p", F.lit(None).cast("double").alias("g")))
    out = model[0]
    for m in model[1:]:
        out = out.unionByName(m)
    return cut(out.groupBy("lang", "n", "key").agg(F.max("p").cast("float").alias("p"), F.max("g").cast("float").alias("g")))


def log_probabilities(ks: list[np.ndarray], before: list[np.ndarray], model: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Natural logarithm of the interpolated probability for each n-gram; ``ks[n - 1]`` keys of order n, ``before[n - 1]`` of the context of order n."""

    def look(n, key, which):
        sorted_keys, *values = model.get(n, (np.zeros(0, np.int64), np.zeros(0), np.zeros(0)))
        if not len(sorted_keys):
            return np.full(len(key), np.nan)
        at = np.minimum(np.searchsorted(sorted_keys, key), len(sorted_keys) - 1)
        return np.where(sorted_keys[at] == key, values[which][at], np.nan)

    q = np.full(len(ks[0]), model[0][1][0])
    for n in range(1, len(ks) + 1):
        p = look(n, ks[n - 1], 0)
        if n > 1:
            g = look(n - 1, before[n - 2], 1)
            q = np.where(np.isnan(g), q, g * q)  # a context never seen leaves all to the lower order
        q = np.where(np.isnan(p), q, p)
    return np.log(q)


def chunk_column(parts, of):
    """The chunk of a row: its language, and a hash over as many parts as the language has."""
    return F.xxhash64("lang", F.pmod(of, F.coalesce(parts, F.lit(1).cast("long")))).alias("chunk")


def dealt(docs: DataFrame, good: DataFrame, chunk_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts as blocks (chunk, block) partitioned by chunk, the trusted ids (chunk, doc_id), and the chunks' languages (chunk, lang).

    A chunk is of one language and a hash of doc_id, as many for each language as its size asks for. Rows without doc_id, which
    are never trusted, are dealt by their text and by where they are read, so that they don't all meet in one chunk.
    """
    sizes = cut(docs.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes")).select(F.col("lang").alias("l"), F.greatest(F.ceil(F.col("bytes") / chunk_bytes), F.lit(1)).cast("long").alias("parts")))
    by_id = F.xxhash64("doc_id")
    own = docs.join(F.broadcast(sizes), F.col("lang").eqNullSafe(F.col("l")), "left")  # a row for each language
    own = own.select(chunk_column(F.col("parts"), F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.spark_partition_id())).otherwise(by_id)), "doc_id", "lang", "text")
    ids = docs.select("doc_id", "lang").join(good, "doc_id", "left_semi").distinct()
    ids = ids.join(F.broadcast(sizes), F.col("lang").eqNullSafe(F.col("l")), "left").select(chunk_column(F.col("parts"), by_id), "doc_id")
    langs = sizes.select(F.col("l").alias("lang"), "parts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return packed(own).repartition("chunk"), ids, langs.select(chunk_column(F.col("parts"), F.col("part")), "lang")


def chunk_keys(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """chunk, lang, n, key: the distinct n-grams of each chunk, of the orders 1 to ``order``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple] = {}
        for b in batches:
            for chunk, block in zip(b.column(0).to_pylist(), b.column(1)):
                t = unpacked(block.as_py())
                for p, at, _ in stretches((x.as_py() for x in t.column("text")), order):
                    new = pd.unique(keys(p, order)[-1][at])
                    old = found.get(chunk)
                    found[chunk] = (t.column("lang")[0].as_py(), new if old is None else pd.unique(np.concatenate([old[1], new])))
        while found:
            chunk, (lang, top) = found.popitem()
            sets = [top]
            for n in range(order - 1, 0, -1):  # the ends of longer ones, and their contexts
                k = sets[-1].view(np.uint64)
                sets.append(pd.unique(np.concatenate([(k & np.uint64((1 << 16 * n) - 1)), k >> np.uint64(16)])).view(np.int64))
            for n, s in zip(range(order, 0, -1), sets):
                s = np.sort(s)
                for i in range(0, len(s), 100_000):
                    part = s[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk, np.int64)), pa.array([lang] * len(part), pa.string()), pa.array(np.full(len(part), n, np.int32)), pa.array(part)], ["chunk", "lang", "n", "key"])

    return rows.mapInArrow(run, "chunk long, lang string, n int, key long")


def score(rows: DataFrame, langs: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, lang, perplexity for each text of the blocks; null where the language has no model."""
    wanted = chunk_keys(rows, order)
    m = model.withColumnsRenamed({"lang": "l", "n": "mn", "key": "mk"})
    same = F.col("lang").eqNullSafe(F.col("l"))
    hits = wanted.join(m, same & (F.col("n") == F.col("mn")) & (F.col("key") == F.col("mk"))).select("chunk", "n", "key", "p", "g")
    none = langs.join(F.broadcast(m.filter("mn = 0")), same).select("chunk", F.lit(0).alias("n"), F.lit(0).cast("long").alias("key"), "p", "g")

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        ns = right.column("n").to_numpy()
        arrays = [right.column(c).to_numpy() for c in ("key", "p", "g")]
        local = {}
        for n in np.unique(ns):
            k, p, g = (a[ns == n] for a in arrays)
            o = np.argsort(k)
            local[int(n)] = (k[o], p[o].astype(float), g[o].astype(float))
        ids, langs, out = [], [], []
        for block in left.column("block"):
            t = unpacked(block.as_py())
            ids += t.column("doc_id").to_pylist()
            langs += t.column("lang").to_pylist()
            sums, n = np.zeros(t.num_rows), np.zeros(t.num_rows)
            for p, at, owner in stretches((x.as_py() for x in t.column("text")), order) if 0 in local else ():
                ks = keys(p, order)
                codes, first = distinct_places(ks[-1], at)
                logs = log_probabilities([k[first] for k in ks], [k[first - 1] for k in ks[:-1]], local)
                sums += np.bincount(owner, logs[codes], t.num_rows)
                n += np.bincount(owner, minlength=t.num_rows)
            with np.errstate(invalid="ignore", divide="ignore"):
                out.append(np.where(n > 0, np.exp(-sums / n), np.nan))
        values = np.concatenate(out) if out else np.zeros(0)
        release()
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "lang": pa.array(langs, pa.string()), "perplexity": pa.array(values, pa.float64(), from_pandas=True)})

    return rows.groupBy("chunk").cogroup(hits.unionByName(none).groupBy("chunk")).applyInArrow(place, "doc_id long, lang string, perplexity double")


def good_ids(labels: DataFrame) -> DataFrame:
    lab = pick(labels, "doc_id", "quality").filter("doc_id is not null and quality in (0, 1)")
    return lab.groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")


def held_out(c: str = "doc_id"):
    return F.pmod(F.xxhash64(c), F.lit(HELD_OUT)) == 0


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, lang, perplexity, threshold, keep; one row for each input row."""
    d = pick(docs, "doc_id", "text", "lang").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    full, blank = d.filter(F.coalesce("text", F.lit("")).rlike(r"(?U)\S")), d.filter(~F.coalesce("text", F.lit("")).rlike(r"(?U)\S"))
    good = cut(good_ids(labels))
    rows, ids, langs = dealt(full, good, chunk_bytes)
    model = train(highest_counts(rows, ids.filter(~held_out()), order), order)
    scores = cut(score(rows, langs, model, order))
    known = scores.join(good, "doc_id", "left_semi").filter("perplexity is not null")
    # held-out documents set the threshold; a language with none of them falls back on its training documents
    limits = known.groupBy("lang").agg(
        F.coalesce(F.percentile_approx(F.when(held_out(), F.col("perplexity")), quantile, 100_000), F.percentile_approx("perplexity", quantile, 100_000)).alias("q")
    )
    limits = limits.select(F.col("lang").alias("l"), F.col("q").alias("threshold"))
    out = scores.join(F.broadcast(limits), F.col("lang").eqNullSafe(F.col("l")), "left")
    out = out.select("doc_id", "lang", "perplexity", "threshold", (F.col("perplexity").isNull() | F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold"))).alias("keep"))
    none = F.lit(None).cast("double")
    return out.unionByName(blank.select("doc_id", "lang", none.alias("perplexity"), none.alias("threshold"), F.lit(False).alias("keep")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op5_kneser_ney": query}
