"""Operator 2: secret scans by token efficiency.

A BPE vocabulary learned on ordinary text spends few tokens on words and many on
random strings. Each run of at least ``MIN_CHARS`` key characters is encoded
with a tiktoken vocabulary; fewer than ``MAX_RATIO`` characters for each token
exposes it, unless it is a known kind of digest or identifier:

* runs of digits only (card, phone and record numbers), UUIDs, dates and versions;
* hexadecimal strings of a digest's length (MD5, SHA-1, SHA-2) that no
  credential word (token, secret, key, password, ...) introduces;
* subresource-integrity digests (``sha256-...``), paths, host names and e-mail addresses.

A run of one class of letters only needs the stricter ``MAX_RATIO_ONE_CLASS``.
Documents are filtered in the JVM by the run's pattern; only those that have a
run go to Python, in Arrow batches. There is no shuffle. Whole texts are read.

Defined results: null and empty texts have no findings and pass redaction
unchanged; each finding is one row, in order of position; repeated rows and
repeated or null doc_id give findings for every row; empty tables give empty
results; extra columns are ignored by ``scan`` and kept by ``stage``. Offsets
count Unicode code points. Very long texts are scanned whole, and so are very long runs; a ratio equal to the
limit is no finding. The secret itself is never returned, only its first
four characters and a SHA-256 prefix.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlake.llm.common import TOKENIZERS, pick, table

MIN_CHARS = 20
MAX_RATIO = 2.5
MAX_RATIO_ONE_CLASS = 1.5
RUN = r"[A-Za-z0-9+/_=\-]{%d,}"
PLACEHOLDER = "[SECRET]"

CREDENTIAL = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|passphrase|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth(?:orization)?|bearer|credential|signing[_ -]?key|client[_ -]?key|key)[\"'`]?\s*(?::=|=>|[:=]|\bis\b)?\s*[\"'`]?$")
UUID = re.compile(r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
HEX = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
DIGEST_CHARS = {32, 40, 48, 56, 64, 96, 128}
INTEGRITY = re.compile(r"(?i)(?:md5|sha1|sha224|sha256|sha384|sha512)[-_=:]")


@lru_cache(maxsize=4)
def encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("fernlake", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def judge(text: str, start: int, end: int, tokens, max_ratio: float = MAX_RATIO, one_class: float = MAX_RATIO_ONE_CLASS) -> tuple[int, float] | None:
    """Number of tokens and characters for each, where text[start:end] looks like a secret."""
    run = text[start:end]
    core = run.strip("=-_/+")
    if not core:
        return None
    digits = sum(c.isdigit() for c in core)
    lowers = sum(c.islower() for c in core)
    uppers = sum(c.isupper() for c in core)
    if digits + core.count("-") + core.count("/") + core.count("_") == len(core):
        return None
    if UUID.fullmatch(core) or INTEGRITY.match(run):
        return None
    before = text[max(0, start - 48) : start]
    named = CREDENTIAL.search(before) is not None or ("=" in run[:-2] and CREDENTIAL.search(before + run[: run.index("=") + 1]) is not None)
    if HEX.fullmatch(core) and len(core) in DIGEST_CHARS and not named:
        return None
    if not named and (text[end : end + 1] in ("@",) or before[-1:] == "@" or before[-3:] == "://"):
        return None
    if not named and max(map(len, re.split(r"[-_/+=]", core))) < 12:  # paths and hyphenated words
        return None
    n = len(tokens.encode_ordinary(run))
    ratio = len(run) / n
    mixed = (digits > 0 and lowers + uppers > 0) or (uppers > 1 and lowers > 1 and not core[1:].islower())
    return (n, ratio) if ratio < (max_ratio if mixed else one_class) else None


def find(text: str, tokens, pattern: re.Pattern) -> list[tuple[int, int, int, float]]:
    """(start, end, tokens, ratio) of each secret of a text, by position."""
    out = []
    for m in pattern.finditer(text):
        if (found := judge(text, m.start(), m.end(), tokens)) is not None:
            out.append((m.start(), m.end(), *found))
    return out


def _findings(vocabulary: str, min_chars: int):
    @F.pandas_udf("array<struct<start:int,end:int,n_tokens:int,chars_per_token:double,shown:string,digest:string>>")
    def findings(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens, pattern = encoding(vocabulary), re.compile(RUN % min_chars)
        for batch in texts:
            yield pd.Series(
                [[(a, b, n, round(r, 6), t[a : a + 4], hashlib.sha256(t[a:b].encode()).hexdigest()[:16]) for a, b, n, r in find(t, tokens, pattern)] if t is not None else None for t in batch],
                dtype=object,
            )

    return findings


def _redacted(vocabulary: str, min_chars: int):
    @F.pandas_udf("string")
    def redacted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens, pattern = encoding(vocabulary), re.compile(RUN % min_chars)

        def clean(t):
            if t is None:
                return None
            for a, b, *_ in reversed(find(t, tokens, pattern)):
                t = t[:a] + PLACEHOLDER + t[b:]
            return t

        for batch in texts:
            yield pd.Series([clean(t) for t in batch], dtype=object)

    return redacted


def has_run(text: Column, min_chars: int = MIN_CHARS) -> Column:
    return text.rlike(RUN % min_chars)


def scan(docs: DataFrame, tokenizers: str = TOKENIZERS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, start, end, n_tokens, chars_per_token, shown, digest; one row for each finding."""
    d = pick(docs, "doc_id", "text").filter(has_run(F.col("text"), min_chars))
    hits = d.select("doc_id", F.explode(_findings(f"{tokenizers}/byte_bpe_50k.tiktoken", min_chars)("text")).alias("hit"))
    return hits.select("doc_id", "hit.*")


def redact(docs: DataFrame, tokenizers: str = TOKENIZERS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents with each secret replaced by a placeholder; ``n_chars``, if there, follows the text where it changed."""
    names = docs.columns
    flat = docs.toDF(*[f"__in_{i}" for i in range(len(names))])
    old = F.col(f"__in_{names.index('text')}").cast("string")
    only = F.when(has_run(old, min_chars), old)
    d = flat.withColumn("__fl_new", _redacted(f"{tokenizers}/byte_bpe_50k.tiktoken", min_chars)(only))
    columns = {"text": F.coalesce("__fl_new", old)}
    if "n_chars" in names:
        at, kind = f"__in_{names.index('n_chars')}", docs.schema[names.index("n_chars")].dataType
        columns["n_chars"] = F.when(F.col("__fl_new") != old, F.length("__fl_new").cast(kind)).otherwise(F.col(at))
    return d.select(*[columns.get(c, F.col(f"__in_{i}")).alias(f"__in_{i}") for i, c in enumerate(names)]).toDF(*names)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced."""
    return redact(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op2_secret_scan": query}
