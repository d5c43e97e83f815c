"""Audio and image files. Decoding goes as far as the standard library: WAV, and uncompressed band arrays as .npy."""

from __future__ import annotations

import io
import struct
import wave
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernlake import metadata as M
from fernlake.functions.scalar import band_index

WAV = "sample_rate int, channels int, samples array<short>"
TENSOR = "shape array<int>, data array<float>"


def decode_wav(blob: bytes, start: float | None = None, end: float | None = None) -> tuple[int, int, np.ndarray]:
    """Rate, channels and interleaved 16-bit samples between two times in seconds, padded with silence to one second."""
    with wave.open(io.BytesIO(blob)) as f:
        rate, channels, width = f.getframerate(), f.getnchannels(), f.getsampwidth()
        raw = f.readframes(f.getnframes())
    if width == 2:
        x = np.frombuffer(raw, "<i2")
    elif width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.int16) - 128) << 8
    elif width == 4:
        x = (np.frombuffer(raw, "<i4") >> 16).astype(np.int16)
    else:
        raise ValueError(f"samples of {width} bytes aren't supported")
    x = x.reshape(-1, channels)
    a = int((start or 0) * rate)
    x = x[a : int(end * rate) if end is not None else len(x)]
    if len(x) < rate:
        x = np.concatenate([x, np.zeros((rate - len(x), channels), np.int16)])
    return rate, channels, x.astype(np.int16).ravel()


def read_audio(spark: SparkSession, folder: str, rows: DataFrame | None = None, file: str = "filename", span: str | None = None) -> DataFrame:
    """Rows joined to their decoded WAV files; ``span`` names a column "start,end" in seconds, empty for the whole file."""
    blobs = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("__file"), "content")
    rows = blobs.select(F.col("__file").alias(file)) if rows is None else rows
    j = rows.withColumn("__file", F.element_at(F.split(file, "/"), -1)).join(blobs, "__file").drop("__file")
    at = F.split(F.col(span), ",") if span else F.array(F.lit(None).cast("string"), F.lit(None).cast("string"))

    @F.pandas_udf(f"struct<{', '.join(p.replace(' ', ':', 1) for p in WAV.split(', '))}>")
    def decoded(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for blob, start, end in batches:
            out = [decode_wav(b, None if pd.isna(s) else s, None if pd.isna(e) else e) for b, s, e in zip(blob, start, end)]
            yield pd.DataFrame(out, columns=["sample_rate", "channels", "samples"])

    times = [F.get(at, F.lit(i)).try_cast("double") for i in (0, 1)]
    return j.withColumn("audio", decoded(F.col("content"), *times)).drop("content")


def image_column(df: DataFrame, use=None, exclude=None) -> str:
    names = [c for c in M.usable_columns(df, use, exclude) if "FileName" in M.semantic_types(df, c)]
    if not names:
        raise ValueError("no column of image files")
    return names[0]


def grouping_key(df: DataFrame) -> str | None:
    """The one grouping key, else the one suggested; None where there isn't exactly one."""
    for role in ("GroupingKey", "SuggestedGroupingKey"):
        if names := M.with_role(df, role):
            return names[0] if len(names) == 1 else None
    return None


def media_column(df: DataFrame, column: str | None, role: str, default_first: bool = False) -> str:
    """The named column, else the first with the role, else the first at all or an error."""
    if column:
        return column
    if names := M.with_role(df, role):
        return names[0]
    if default_first:
        return df.columns[0]
    raise ValueError(f"no column with the role {role}")


def group_bands(df: DataFrame, group: str, file: str, band: str, order: Iterable[str]) -> DataFrame:
    """One row for each tile with its files in the order of their bands, and the rest of its first row."""
    keep = [c for c in df.columns if c not in (group, file, band)]
    first = F.min_by(F.struct(*keep), F.struct(*order)).alias("__r") if keep else F.lit(None).alias("__r")
    g = df.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(band_index(F.col(band)).alias("band"), F.col(file).alias("file")))).alias("bands"), first)
    return g.select(group, "bands", *(["__r.*"] if keep else []))


def resample(x: np.ndarray, size: int) -> np.ndarray:
    """Bilinear resampling to a square, pixel centres aligned."""
    h, w = x.shape
    if h == w == size:
        return x.astype(np.float32)
    r, c = (np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1) for n in (h, w))
    r0, c0 = r.astype(int), c.astype(int)
    r1, c1 = np.minimum(r0 + 1, h - 1), np.minimum(c0 + 1, w - 1)
    fr, fc = (r - r0)[:, None], (c - c0)[None]
    x = x.astype(float)
    return ((x[r0][:, c0] * (1 - fc) + x[r0][:, c1] * fc) * (1 - fr) + (x[r1][:, c0] * (1 - fc) + x[r1][:, c1] * fc) * fr).astype(np.float32)


def stack_bands(bands: DataFrame, group: str, blobs: DataFrame, size: int | None = None, stacked: int = 12) -> DataFrame:
    """Tiles (group, bands) with their arrays stacked; a band that is missing is zeros. ``blobs``: (file, content as .npy)."""
    e = bands.select(group, F.explode("bands").alias("b")).select(group, "b.band", "b.file").join(blobs, "file")
    if size is None:  # the largest height in the first tile
        first = e.orderBy(group).select(group).first()
        size = max(np.load(io.BytesIO(r["content"])).shape[0] for r in e.filter(F.col(group) == first[0]).select("content").toLocalIterator())

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((stacked, size, size), np.float32)
        for band, blob in zip(pdf["band"], pdf["content"]):
            out[band] = resample(np.load(io.BytesIO(blob)), size)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "shape": [list(out.shape)], "data": [out.ravel()]})

    return e.groupBy(group).applyInPandas(one, f"`{group}` {bands.schema[group].dataType.simpleString()}, {TENSOR}")


def compress(x: np.ndarray) -> bytes:
    """A tensor behind a 16-byte header: type code, then three sizes."""
    return struct.pack("cIII", np.dtype(x.dtype).char.encode(), *x.shape) + zlib.compress(np.ascontiguousarray(x).tobytes())


def decompress(blob: bytes) -> np.ndarray:
    kind, *shape = struct.unpack("cIII", blob[:16])
    return np.frombuffer(zlib.decompress(blob[16:]), np.dtype(kind.decode())).reshape(shape)


def max_over_frames(df: DataFrame, key: str, frames: str) -> DataFrame:
    """The greatest value in each place over a row's frames (an array of arrays)."""
    e = df.select(key, F.explode(frames).alias("f")).select(key, F.posexplode("f").alias("i", "x"))
    g = e.groupBy(key, "i").agg(F.max("x").alias("x"))
    return g.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("pooled"))


def first_rows(df: DataFrame, group: str, order: Iterable[str]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter("__n = 1").drop("__n")
