"""Operator 9: SimHash near-dedup by meet-in-the-middle ball hashing.

Each document has a SimHash signature of ``BITS`` bits over its lower-cased words,
weighted by the square root of their counts. ``TABLES`` fingerprints of
``WIDTH`` bits are drawn from it. To find all pairs of fingerprints within
Hamming distance ``RADIUS`` = 2, every fingerprint emits all variants within half the
radius (itself and each with one bit flipped); two fingerprints lie within the
radius exactly when they emit a common variant. The variants are shuffled, packed, and sorted.
Of up to ``CROWD`` members of one variant all pairs are linked, and the links are deduplicated and verified on the
whole signature (at most ``MAX_DISTANCE`` bits differ). Larger sets of members are deduplicated (a cluster shares most
of its variants) and joined to their signatures; within each set a search from member to member, over those not yet reached, finds the
verified links that connect all that verified pairs would, near clusters in linear time. So every pair that meets is verified or
connected by verified links, which are then closed to groups.

Equal signatures (exact copies, white space, case, punctuation) are one node from the
start, so thousands of copies emit once. Nothing is capped and no bucket is skipped.
Signatures, nodes and links are written to the checkpoint folder; texts are
read once and never shuffled.

Defined results, one row for each input row:
* null text and text without words, and rows with null doc_id, are alone: group_id is doc_id, keep is true;
* group_id is the least doc_id of the group, and its document is kept;
* repeated rows of one doc_id are members of their texts' groups each for itself; ``decide`` keeps every row with the
  group's least doc_id, ``dedup`` keeps exactly one row of each group;
* very long texts are signed whole; a bit whose words weigh as much for as against it is set; pairs at exactly ``MAX_DISTANCE`` are near;
* empty tables give empty results; extra columns are ignored by ``decide`` and kept by ``dedup``, whatever they are called.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernlake.llm.common import cut, pick, release, table
from fernlake.llm.components import components

BITS = 256
WIDTH = 40
TABLES = 16
RADIUS = 2
MAX_DISTANCE = 38
#: Members of one variant of which all pairs are linked; more are searched with their signatures.
CROWD = 8
#: Nodes whose variants are packed together (a power of 2, 2^16 at most), and variants of a shard.
BATCH, SHARD_VARIANTS = 4096, 2_000_000
#: Dropped doc_ids up to this number are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
WORD = re.compile(r"\w+")


class Signer:
    """SimHash signatures of texts; the digests of recent words are remembered."""

    def __init__(self, most: int = 200_000):
        self.digests: dict[str, bytes] = {}
        self.most = most

    def digest(self, word: str) -> bytes:
        import xxhash

        b = word.encode("utf-8", "surrogatepass")
        d = xxhash.xxh3_128_digest(b) + xxhash.xxh3_128_digest(b, seed=1)
        if len(self.digests) >= self.most:
            self.digests.clear()
        self.digests[word] = d
        return d

    def __call__(self, text: str | None) -> bytes | None:
        counts = Counter(WORD.findall(text.lower())) if text else None
        if not counts:
            return None
        known = self.digests
        packed = b"".join([known.get(w) or self.digest(w) for w in counts])
        bits = np.unpackbits(np.frombuffer(packed, np.uint8)).reshape(-1, BITS)
        weights = np.sqrt(np.fromiter(counts.values(), np.float32, len(counts)))
        sums = weights @ bits.astype(np.float32)
        return np.packbits(sums * 2 >= weights.sum()).tobytes()


def drawn(tables: int = TABLES, width: int = WIDTH) -> np.ndarray:
    """The bits of each fingerprint, spread over the signature as evenly as chance allows."""
    rng, out, left = np.random.default_rng(11), [], np.array([], int)
    for _ in range(tables):
        if len(left) < width:
            left = np.concatenate([left, rng.permutation(np.setdiff1d(np.arange(BITS), left))])
        out.append(np.sort(left[:width]))
        left = left[width:]
    return np.array(out)


def fingerprints(signatures: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """One column for each table: the drawn bits with the table's number above them."""
    unpacked = np.unpackbits(signatures, axis=1).astype(np.int64)
    powers = 1 << np.arange(bits.shape[1], dtype=np.int64)
    return np.column_stack([unpacked[:, b] @ powers | t << 48 for t, b in enumerate(bits)])


def ball(prints: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """All variants of each fingerprint within half the radius."""
    flips = np.concatenate([[0], 1 << np.arange(width, dtype=np.int64)])
    return prints[..., None] ^ flips


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), sig for each row; sig is null where doc_id is null or the text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()
        for b in batches:
            sigs = [signer(t.as_py()) if i.is_valid else None for i, _, t in zip(*b.columns)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sigs, pa.binary())], ["doc_id", "h", "sig"])
        del signer
        release()

    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return d.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, "doc_id long, h long, sig binary")


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray | pa.ChunkedArray]]:
    """The columns of ordered batches, divided anew so that rows equal in the first column come together."""
    held: list[pa.RecordBatch] = []

    def columns(parts):
        t = pa.Table.from_batches(parts)
        return [c.to_numpy() if pa.types.is_integer(c.type) else c for c in t.columns]

    for b in batches:
        if not b.num_rows:
            continue
        v = b.column(0).to_numpy()
        at = int(np.searchsorted(v, v[-1]))
        if held and (at or held[-1].column(0)[-1].as_py() != v[0]):
            yield columns([*held, b.slice(0, at)])
            held = []
        elif at:
            yield columns([b.slice(0, at)])
        held.append(b.slice(at))
    if held:
        yield columns(held)


def planes(x: np.ndarray) -> bytes:
    """Numbers with the bytes of one weight side by side, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def unplaned(b: bytes, kind: type) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


def links(nodes: DataFrame, tables: int = TABLES, shard_variants: int = SHARD_VARIANTS) -> DataFrame:
    """Distinct (a, b, crowd): the pairs of nodes that emit a common variant or, where ``crowd``, a set of more than ``CROWD`` such nodes (a) and its member (b).

    Variants travel packed: those of ``BATCH`` nodes, spread evenly over 44 bits by a bijection, are sorted, cut by shards at equal distances, and sent as gaps
    with the numbers of their nodes in the batch. A shard holds about ``shard_variants``. On very large tables both should grow as memory allows (to 100 million
    variants and a million nodes at 100 TB), since each batch sends a row to each shard.
    """
    bits, batch_bits = drawn(tables), BATCH.bit_length() - 1
    shards = max(1, -(-nodes.count() * tables * (1 + WIDTH) // shard_variants))
    edges = np.array([-(-(i << 44) // shards) for i in range(shards + 1)], np.uint64)
    mask = np.uint64((1 << 44) - 1)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BATCH):
                part = b.slice(i, BATCH)
                sigs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, BITS // 8)
                prints = fingerprints(sigs, bits)
                prints = ball(prints & (1 << 48) - 1 | prints >> 48 << 40).reshape(len(sigs), -1).view(np.uint64)
                with np.errstate(over="ignore"):
                    prints *= np.uint64(0x9E3779B97F5)  # odd, so no two variants become one
                prints &= mask
                prints <<= np.uint64(batch_bits)
                prints |= np.arange(len(sigs), dtype=np.uint64)[:, None]
                x = np.sort(prints.ravel())
                v, n = x >> np.uint64(batch_bits), (x & np.uint64(BATCH - 1)).astype(np.uint16)
                at = np.searchsorted(v, edges)
                own = planes(np.diff(part.column(0).to_numpy(zero_copy_only=False), prepend=0))
                rows = [(s, own, planes(np.diff(v[p:q], prepend=edges[s])), planes(n[p:q])) for s, (p, q) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())) if q > p]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["shard", "nodes", "gaps", "numbers"])
        release()

    def meet(t: pa.Table) -> pa.Table:
        import xxhash

        # variants above, ranks of the nodes below: one sort of plain numbers orders both
        own = [unplaned(x.as_py(), np.int64).cumsum() for x in t.column("nodes")]
        known = np.unique(np.concatenate(own))
        width = np.uint64(max(1, int(len(known) - 1).bit_length()))
        parts = [unplaned(g.as_py(), np.uint64).cumsum(dtype=np.uint64) << width | np.searchsorted(known, o).astype(np.uint64)[unplaned(k.as_py(), np.uint16)] for o, g, k in zip(own, t.column("gaps"), t.column("numbers"))]
        x = np.concatenate(parts)
        del parts
        x.sort()
        v, n = x >> width, known[(x & np.uint64((1 << int(width)) - 1)).astype(np.int64)]
        starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(v)]]))
        few = np.repeat(sizes <= CROWD, sizes)
        found = [np.zeros((0, 2), np.int64)]
        for d in range(1, CROWD):
            i = np.flatnonzero((v[d:] == v[:-d]) & few[d:])
            if not len(i):
                break
            found.append(np.column_stack([n[i], n[i + d]]))
        pairs = np.unique(np.concatenate(found), axis=0)  # nodes are in order within a variant
        sets = {}
        for s, m in zip(starts[sizes > CROWD].tolist(), sizes[sizes > CROWD].tolist()):
            members = n[s : s + m]
            sets[xxhash.xxh3_64_intdigest(members.tobytes())] = members
        names = np.repeat(np.array(list(sets), np.uint64).view(np.int64), [len(m) for m in sets.values()])
        release()
        return pa.table({"a": np.concatenate([pairs[:, 0], names]), "b": np.concatenate([pairs[:, 1], *sets.values()]), "crowd": np.arange(len(pairs) + len(names)) >= len(pairs)})

    emitted = nodes.select("node", "sig").mapInArrow(emit, "shard long, nodes binary, gaps binary, numbers binary")
    return emitted.groupBy("shard").applyInArrow(meet, "a long, b long, crowd boolean").distinct()


def reached(sigs: np.ndarray, max_distance: int) -> tuple[list[int], list[int]]:
    """Links (from, to) of near signatures that connect what all links of near ones would."""
    words, left, a, b = np.ascontiguousarray(sigs).view(np.uint64), np.arange(len(sigs)), [], []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            x = todo.pop()
            close = np.bitwise_count(words[left] ^ words[x]).sum(axis=1) <= max_distance
            hit = left[close].tolist()
            if hit:
                a += [x] * len(hit)
                b += hit
                todo += hit
                left = left[~close]
    return a, b


def searched(crowds: DataFrame, nodes: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Verified links (a, b) within each set of nodes (a: the set, b: the node)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v, n, sigs in whole(batches):
            sigs = np.frombuffer(b"".join(sigs.to_pylist()), np.uint8).reshape(-1, BITS // 8)
            edges = np.concatenate([[0], np.flatnonzero(v[1:] != v[:-1]) + 1, [len(v)]]).tolist()
            out = []
            for s, e in zip(edges[:-1], edges[1:]):
                a, b = reached(sigs[s:e], max_distance)
                if a:
                    out.append(np.column_stack([n[s:e][a], n[s:e][b]]))
            if out:
                pairs = np.unique(np.concatenate(out), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    sets = crowds.select(F.col("a").alias("name"), F.col("b").alias("node")).join(nodes.select("node", "sig"), "node")
    return sets.select("name", "node", "sig").repartition("name").sortWithinPartitions("name", "node").mapInArrow(search, "a long, b long").distinct()


def verified(pairs: DataFrame, nodes: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """The links whose whole signatures differ in at most so many bits."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.array([np.frombuffer(s, np.uint8) for s in b.column(i).to_pylist()]).reshape(-1, BITS // 8) for i in (2, 3))
            close = np.bitwise_count(x ^ y).sum(axis=1) <= max_distance
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(close))

    of = nodes.select("node", "sig")
    both = pairs.join(of.toDF("a", "sa"), "a").join(of.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(near, "a long, b long")


def decide_signed(signed: DataFrame, tables: int = TABLES, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """sig, group_id, group_size, for the distinct signatures of a written table.

    Nodes are numbered, not hashed: each is sent with every variant, and small numbers compress where hashes don't.
    """
    distinct = cut(signed.filter("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    nodes = cut(distinct.withColumn("node", F.monotonically_increasing_id()))
    met = cut(links(nodes, tables))
    near = verified(met.filter("not crowd").select("a", "b"), nodes, max_distance).union(searched(met.filter("crowd"), nodes, max_distance))
    roots = components(cut(near))
    of = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = of.groupBy("root").agg(F.min("least").alias("group_id"), F.sum("n").alias("group_size"))
    return of.join(groups, "root").select("sig", "group_id", "group_size")


def decide(docs: DataFrame, tables: int = TABLES, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """doc_id, group_id, group_size, keep; one row for each input row."""
    signed = cut(sign(docs))
    grouped = signed.join(decide_signed(signed, tables, max_distance), "sig")
    grouped = grouped.select("doc_id", "group_id", "group_size", (F.col("doc_id") == F.col("group_id")).alias("keep"))
    alone = signed.filter("sig is null")
    return grouped.unionByName(alone.select("doc_id", F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("keep")))


def dedup(docs: DataFrame, tables: int = TABLES, max_distance: int = MAX_DISTANCE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The documents with one row of each group, and all their columns.

    The row kept has the least doc_id, of several such rows that with the least hash of its text, and of rows equal in both any one.
    """
    signed = cut(sign(docs))
    rows = signed.join(decide_signed(signed, tables, max_distance).filter("group_size > 1"), "sig").groupBy("group_id", "doc_id", "h").agg(F.count("*").alias("n"))
    first = (F.col("doc_id") == F.col("group_id")) & (F.row_number().over(Window.partitionBy("group_id", "doc_id").orderBy("h")) == 1)
    found = cut(rows.withColumn("first", first).filter("not first or n > 1").select(F.col("doc_id").alias("__fl_id"), F.col("h").alias("__fl_h"), "first"))
    n_lost, n_twice = found.agg(F.count_if(~F.col("first")), F.count_if(F.col("first"))).first()
    lost, twice = found.filter("not first").drop("first"), found.filter("first").drop("first")
    flat = docs.toDF(*[f"__in_{i}" for i in range(len(docs.columns))])
    own = flat.withColumns({"__fl_id": F.col(f"__in_{docs.columns.index('doc_id')}").cast("long"), "__fl_h": F.xxhash64(F.col(f"__in_{docs.columns.index('text')}").cast("string"))})
    by = ["__fl_id", "__fl_h"]
    kept = own.join(F.broadcast(lost) if n_lost <= broadcast_rows else lost, by, "left_anti")
    if n_twice:  # rows equal in doc_id and text
        some = F.broadcast(twice) if n_twice <= broadcast_rows else twice
        kept = kept.join(some, by, "left_anti").unionByName(kept.join(some, by, "left_semi").dropDuplicates(by))
    return kept.select(*flat.columns).toDF(*docs.columns)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return dedup(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(table(spark, sf_dir, "documents"))


QUERIES = {"op9_simhash_dedup": query}
