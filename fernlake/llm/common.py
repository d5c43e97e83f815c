"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read from Parquet."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str, optional: Iterable[str] = ()) -> DataFrame:
    """Only the named columns, found by exact spelling and, where a name occurs twice, its first column.

    Columns with clashing names (repeated, or equal but for case) would make
    ``select`` ambiguous; here they are addressed by position. A missing column
    raises ``ValueError`` unless it is listed in ``optional``, which gives nulls.
    """
    where: dict[str, int] = {}
    for i, c in enumerate(df.columns):
        where.setdefault(c, i)
    lower = {c.lower(): i for c, i in reversed(where.items())}
    out = []
    flat = df.toDF(*[f"__fl_{i}" for i in range(len(df.columns))])
    optional = set(optional)
    for n in names:
        i = where.get(n, lower.get(n.lower()))
        if i is not None:
            out.append(F.col(f"__fl_{i}").alias(n))
        elif n in optional:
            out.append(F.lit(None).cast("string").alias(n))
        else:
            raise ValueError(f"no column {n!r} among {df.columns}")
    return flat.select(*out)


def with_checkpoints(spark: SparkSession) -> str:
    """The folder for checkpoints: what the cluster names in ``spark.checkpoint.dir``.

    Only a session of one machine that names none (as in tests) gets a folder of its own; a cluster that names none is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="fernlake-"))
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """The same rows and columns, written as Parquet to the shared checkpoint folder and read again: each reader takes only the columns it needs."""
    path = f"{with_checkpoints(df.sparkSession)}/written-{uuid.uuid4().hex}"
    flat = [f"__fl_{i}" for i in range(len(df.columns))]
    df.toDF(*flat).write.parquet(path)
    return df.sparkSession.read.parquet(path).toDF(*df.columns)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder, so that later work doesn't repeat what made them."""
    with_checkpoints(df.sparkSession)
    return df.checkpoint()


#: Text of a block at most, but for a single row that is longer.
BLOCK_BYTES = 4_000_000


def packed(df: DataFrame, by: str = "chunk", once: str | None = None, most: int = BLOCK_BYTES) -> DataFrame:
    """(chunk, block): the rows of each batch that share a chunk, serialised and compressed together, ``most`` bytes at a time.

    Rows that are to meet in one task travel as blocks of many: texts of a block compress about twice as well as rows do
    one by one in a shuffle, and the receiver gets whole columns. Results mustn't depend on how rows are spread over blocks.
    ``once`` names a number that stands for the row: of rows equal in it, a batch sends one.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
        for b in batches:
            if not b.num_rows:
                continue
            if once:
                b = b.take(pa.array(np.sort(np.unique(b.column(b.schema.get_field_index(once)).to_numpy(zero_copy_only=False), return_index=True)[1])))
            chunks = b.column(b.schema.get_field_index(by)).to_numpy(zero_copy_only=False)
            order = np.argsort(chunks, kind="stable")
            chunks = chunks[order]
            sizes = sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)), np.zeros(b.num_rows, np.int64))
            full = np.cumsum(sizes[order]) // most
            edges = np.flatnonzero(np.concatenate([[True], (chunks[1:] != chunks[:-1]) | (full[1:] != full[:-1]), [True]]))
            out = []
            for s, e in zip(edges[:-1], edges[1:]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema, options=options) as w:
                    w.write_batch(b.take(pa.array(order[s:e])))
                out.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(chunks[edges[:-1]].astype(np.int64)), pa.array(out, pa.binary())], ["chunk", "block"])

    return df.mapInArrow(run, "chunk long, block binary")


def unpacked(block: bytes):
    """The rows of a block, as an Arrow table."""
    import pyarrow as pa

    return pa.ipc.open_stream(block).read_all()


def release() -> None:
    """Give memory that a Python worker doesn't need any more back to the machine; workers stay for later tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
