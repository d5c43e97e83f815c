"""Operator 4: byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are exploded into pre-tokens; the merges of byte-pair encoding stay inside a
pre-token, so each distinct pre-token of the corpus is encoded once:

1. documents are dealt by hash to chunks of about ``CHUNK_BYTES`` of text, the one shuffle of the texts, in compressed blocks;
2. each chunk's distinct pre-tokens, in sorted order, go to the shard of the word's hash, where equal words
   of all chunks meet and are encoded once; they travel packed, a row for each chunk and shard;
3. the ids are joined back to the chunks that hold the word by its position among the chunk's sorted words;
4. each chunk's texts meet the chunk's words, and the ids are put in place by the position of the pre-token.

Between the steps only distinct words of a chunk move, not occurrences: positions stay where the text is. The chunk
number depends on the row and the part of the input it lies in, and the order of a chunk's words on the words alone, so a lost task recomputes
the same rows. The texts' shuffle is planned once and read twice (the exchange is reused).

Decoding joins the token-byte table by id: the ids of a batch, flattened with their positions, gather the
bytes of the vocabulary's table, and the documents' bytes are cut at their positions.

Defined results, one row for each input row: null text gives null ids; empty text gives no ids; every other text gives the ids of
the reference encoder, and decoding them gives the text back. Ids outside the vocabulary make decoding raise
``ValueError``; bytes that aren't UTF-8 decode to U+FFFD. Very long texts are encoded whole, as a block of their own; ties between merges
go to the first pair of the lowest rank. Repeated rows and repeated or null doc_id give a row each; empty tables give empty results;
extra columns are ignored by ``encode`` and kept by ``stage``, which replaces columns called ``token_ids`` or ``n_tokens``.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlake.llm.common import TOKENIZERS, packed, release, table, unpacked

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Text of a chunk. A task holds the chunk's distinct words; texts stream past them.
CHUNK_BYTES = 8_000_000
#: Text whose distinct words meet in one shard at most; the words of so much text are held at once.
SHARD_BYTES = 256_000_000
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def ranks(vocabulary: str) -> dict[bytes, int]:
    with open(vocabulary, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=1)
def splitter():
    """Pre-tokens of a text. The standard library's expressions are twice as fast and agree on characters up to U+024F
    but for a few numerals and separators; texts with any other go to the full pattern."""
    import re

    import regex

    full = regex.compile(PATTERN).findall
    fast = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+").findall
    other = re.compile("[^\0-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]").search
    return lambda text: full(text) if other(text) else fast(text)


@lru_cache(maxsize=2)
def word_encoder(vocabulary: str):
    """Ids of the bytes of one pre-token by its merges; the merges run in the vocabulary's library."""
    import tiktoken

    return tiktoken.Encoding("fernlake", pat_str=PATTERN, mergeable_ranks=ranks(vocabulary), special_tokens={})._encode_single_piece


def chunked(d: DataFrame, chunk_bytes: int, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """The rows with ``chunk``, a hash of the row and of the part of the input it is read from over as many chunks as the texts' size asks for; the number of shards for words.

    So copies of a row meet in one chunk only as far as they lie in one part of the input. Both sizes bound what a task holds; on very large tables both
    should grow, to some hundred megabytes at 100 TB, since each chunk sends a packed row to each shard.
    """
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    shards = max(1, min(chunks, int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-size // shard_bytes))
    return d.withColumn("chunk", F.pmod(F.xxhash64(*d.columns, F.spark_partition_id()), F.lit(chunks)).cast("long")), shards


def pack(words: list[str], numbers: list[int]) -> tuple[bytes, bytes]:
    """Words and their growing numbers, compressed; a word may hold any character."""
    import zstandard

    data = [w.encode() for w in words]
    sizes = np.fromiter(map(len, data), np.uint32, len(data))
    gaps = np.diff(np.array(numbers, np.uint32), prepend=np.uint32(0)).astype(np.uint32)
    z = zstandard.ZstdCompressor(level=3)
    return z.compress(np.uint32(len(data)).tobytes() + sizes.tobytes() + b"".join(data)), z.compress(gaps.tobytes())


def unpack(packed: bytes) -> list[str]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = 4 + 4 * n + np.frombuffer(raw, np.uint32, n, 4).cumsum(dtype=np.int64)
    starts = np.concatenate([[4 + 4 * n], ends[:-1]]) if n else ends
    return [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]


def chunk_words(rows: DataFrame, shards: int) -> DataFrame:
    """shard, chunk, words, numbers: the distinct pre-tokens of each chunk with their positions in sorted order.

    ``rows`` are blocks partitioned by chunk, so a task sees all of each of its chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        split = splitter()

        def out(chunk, words):
            by: dict[int, tuple[list, list]] = {}
            for i, w in enumerate(sorted(words)):
                ws, ns = by.setdefault(xxhash.xxh3_64_intdigest(w) % shards, ([], []))
                ws.append(w)
                ns.append(i)
            rows_ = [(s, chunk, *pack(*x)) for s, x in by.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows_), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["shard", "chunk", "words", "numbers"])

        now, words = None, set()
        for b in batches:
            for c, block in zip(b.column(0).to_pylist(), b.column(1)):
                if c != now and words:
                    yield out(now, words)
                    words = set()
                now = c
                for t in unpacked(block.as_py()).column("text"):
                    words.update(split(t.as_py()))
        if words:
            yield out(now, words)
        del words
        release()

    # in order of the chunks, so that a task holds the words of one chunk at a time
    return rows.sortWithinPartitions("chunk").mapInArrow(run, "shard int, chunk long, words binary, numbers binary")


def encoded_words(words: DataFrame, shards: int, vocabulary: str) -> DataFrame:
    """chunk, numbers, sizes, ids: every distinct word encoded once in its shard, and its ids sent to each chunk that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoded, once, z = word_encoder(vocabulary), {}, zstandard.ZstdCompressor(level=3)
        for b in batches:
            sizes, ids = [], []
            for packed in b.column(2):
                found = []
                for w in unpack(packed.as_py()):
                    if (x := once.get(w)) is None:
                        x = once[w] = np.array(encoded(w.encode()), np.uint32).tobytes()
                    found.append(x)
                sizes.append(z.compress((np.fromiter(map(len, found), np.uint32, len(found)) // 4).tobytes()))
                ids.append(z.compress(b"".join(found)))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(3), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], ["chunk", "numbers", "sizes", "ids"])
        del once
        release()

    return words.repartition(shards, "shard").mapInArrow(run, "chunk long, numbers binary, sizes binary, ids binary")


def encode(docs: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, chunk_bytes: int = CHUNK_BYTES, keep: bool = False, decoded: str | None = None) -> DataFrame:
    """doc_id (or, with ``keep``, all columns), token_ids; one row for each input row.

    ``decoded`` names a further column for the text decoded from the ids, made by the same worker as they are: a worker for
    encoding and one for decoding in each task would double what Python holds.
    """
    path = f"{tokenizers}/{vocabulary}"
    names = [c for c in docs.columns if c.lower() not in ("token_ids", "n_tokens")] if keep else ["doc_id"]
    flat = docs.toDF(*[f"__in_{i}" for i in range(len(docs.columns))])
    text = F.col(f"__in_{docs.columns.index('text')}").cast("string")
    carried = [f"__in_{i}" for i, c in enumerate(docs.columns) if c in names]
    if not keep:
        carried = carried[:1]
    d = flat.select(*carried, text.alias("text"))
    other = [c for c in carried if not keep or c != f"__in_{docs.columns.index('text')}"]
    full, shards = chunked(d.filter("text is not null"), chunk_bytes)
    full = full.select("chunk", "text", *other)
    rows = packed(full).repartition("chunk")
    words = encoded_words(chunk_words(rows, shards), shards, path)
    texts_too = keep  # the query needs the ids only
    carried_over = full.select(*(["text"] if texts_too else []), *other)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried_over.schema) + ", token_ids array<int>" + (f", `{decoded}` string" if decoded else "")

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard

        split, z = splitter(), zstandard.ZstdDecompressor()
        number: dict[str, int] = {}
        texts = []  # numbers of each text's words, as first seen
        tables = [unpacked(b.as_py()) for b in left.column("block")]
        for t in (t for table_ in tables for t in table_.column("text")):
            ws = split(t.as_py())
            texts.append(np.fromiter([number.setdefault(w, len(number)) for w in ws], np.int32, len(ws)))
        rank_of = np.empty(len(number), np.int64)  # place among the sorted words
        rank_of[np.fromiter((number[w] for w in sorted(number)), np.int64, len(number))] = np.arange(len(number))
        del number, split
        sizes, which, flat_ids = np.zeros(len(rank_of), np.int64), [], []
        for k, n, i in zip(*(right.column(c).to_pylist() for c in ("numbers", "sizes", "ids"))):
            at = np.frombuffer(z.decompress(k), np.uint32).cumsum(dtype=np.int64)
            sizes[at] = np.frombuffer(z.decompress(n), np.uint32)
            which.append(at)
            flat_ids.append(np.frombuffer(z.decompress(i), np.uint32).astype(np.int32))
        order = np.concatenate(which) if which else np.zeros(0, np.int64)
        if len(order) != len(rank_of):
            raise RuntimeError("a chunk's texts changed between two readings")
        flat_ids = np.concatenate(flat_ids) if flat_ids else np.zeros(0, np.int32)
        starts = np.zeros(len(rank_of), np.int64)
        starts[order] = sizes[order].cumsum() - sizes[order]
        offsets, parts = [0], []
        for w in texts:
            w = rank_of[w]
            n = sizes[w]
            total = int(n.sum())
            parts.append(flat_ids[np.repeat(starts[w] - (n.cumsum() - n), n) + np.arange(total)])
            offsets.append(offsets[-1] + total)
        values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.astype(np.int32), pa.int32()))
        done = pa.concat_tables(tables).drop_columns(["chunk"] if texts_too else ["chunk", "text"]).append_column("token_ids", out)
        if decoded:
            done = done.append_column(decoded, decode_array(out, *token_bytes(path)))
        del tables, texts, rank_of, sizes, which, order, starts, flat_ids, parts, values, out
        release()
        return done

    placed = rows.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(place, schema)
    empty = d.filter("text is null").select(*(["text"] if texts_too else []), *other, F.lit(None).cast("array<int>").alias("token_ids"), *([F.lit(None).cast("string").alias(decoded)] if decoded else []))
    both = placed.unionByName(empty)
    out = [F.col("text" if c == f"__in_{docs.columns.index('text')}" else c).alias(docs.columns[int(c[5:])]) for c in carried]
    return both.select(*out, "token_ids", *([decoded] if decoded else []))


def decode(df: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """The rows with the text of their ids in a further column."""
    path = f"{tokenizers}/{vocabulary}"

    def run():
        @F.arrow_udf("string")
        def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            table_ = token_bytes(path)
            for b in batches:
                yield decode_array(b, *table_)

        return decoded

    return df.withColumn(to, run()(F.col(ids)))


@lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table by id: all bytes, where each token starts, its length (-1: no such id)."""
    rank = ranks(path)
    n = max(rank.values()) + 1
    sizes = np.full(n, -1, np.int64)
    for b, i in rank.items():
        sizes[i] = len(b)
    by = {i: b for b, i in rank.items()}
    data = np.frombuffer(b"".join(by.get(i, b"") for i in range(n)), np.uint8)
    return data, np.concatenate([[0], np.maximum(sizes, 0).cumsum()[:-1]]), sizes


def decode_array(lists: pa.Array, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    out, flat, missing = [], np.asarray(lists.flatten()), lists.is_null().to_numpy(zero_copy_only=False)
    counts = np.where(missing, 0, np.nan_to_num(np.asarray(lists.value_lengths().fill_null(0)))).astype(np.int64)
    ends = counts.cumsum()
    for k, (gone, n, e) in enumerate(zip(missing, counts, ends)):
        if gone:
            out.append(None)
            continue
        w = flat[e - n : e]
        if len(w) and (w.dtype.kind == "f" or w.min() < 0 or w.max() >= len(sizes) or (sizes[w] < 0).any()):
            raise ValueError("a token id outside the vocabulary")
        m = sizes[w]
        total = int(m.sum())
        at = np.repeat(starts[w] - (m.cumsum() - m), m) + np.arange(total) if total else np.zeros(0, np.int64)
        out.append(data[at].tobytes().decode("utf-8", "replace"))
    return pa.array(out, pa.string())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with token_ids, the text decoded from them alone, and n_tokens."""
    return encode(docs, keep=True, decoded="decoded").withColumn("n_tokens", F.size("token_ids").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded again from its ids alone."""
    d = encode(table(spark, sf_dir, "documents"), decoded="decoded")
    return d.select("doc_id", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), F.col("decoded").alias("text"))


QUERIES = {"op4_bpe_codec": query}
