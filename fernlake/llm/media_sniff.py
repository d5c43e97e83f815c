"""Operator 8: media columns, sniffed by signature.

One Aho-Corasick pass over the bytes (read as Latin-1) locates the magic numbers
of all formats; a validator for each format then confirms the structure at the
place found (chunk lengths and checksums, box, page and segment chains, central
directories) and gives the length in bytes. What is confirmed at offset 0, or
recognised as markup, is the blob's true type, which corrects the declared one;
what is confirmed further on, inside containers too, is carved as embedded media. ``data:``
addresses inside markup are decoded and sniffed the same way.

It is a projection in Arrow batches without a shuffle; whole blobs are read.

Defined results, one row for each input row:
* null blob: detected null, no embedded media, not valid, not corrected;
* empty blob: detected ``empty``; unknown bytes: detected ``application/octet-stream``;
* null or empty declared type: ``corrected`` is true if a type was confirmed;
* embedded media lie outside or within one another, and not within one of their own kind: of overlapping ones the first, then longest, stays;
* content of data addresses, base64 or percent-encoded, and media inside it are given at the place of the address;
* very long blobs are read whole; of formats that claim one place, the longest confirmed one is the type;
* repeated rows and repeated or null keys give a row each; empty tables give empty results; extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

import base64
import binascii
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlake.llm.common import pick, table

# Every validator takes the bytes and an offset and returns (type, end) or None.


def png(b, at):
    if b[at : at + 8] != b"\x89PNG\r\n\x1a\n" or b[at + 12 : at + 16] != b"IHDR":
        return None
    i = at + 8
    while i + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, i)
        end = i + 12 + n
        if end > len(b) or not kind.isalpha() or zlib.crc32(b[i + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        i = end
        if kind == b"IEND":
            return "image/png", i
    return None


def jpeg(b, at):
    i, scanned = at + 2, False
    while i + 4 <= len(b):
        if b[i] != 0xFF:
            return None
        m = b[i + 1]
        if m == 0xFF:
            i += 1
        elif m == 0xD9:
            return ("image/jpeg", i + 2) if scanned else None
        elif m == 0x01 or 0xD0 <= m <= 0xD7:
            i += 2
        else:
            n = struct.unpack_from(">H", b, i + 2)[0]
            if n < 2:
                return None
            i += 2 + n
            if m == 0xDA:  # entropy-coded data until a marker that isn't stuffing or a restart
                scanned = True
                while (i := b.find(b"\xff", i)) >= 0 and i + 1 < len(b) and (b[i + 1] == 0 or 0xD0 <= b[i + 1] <= 0xD7):
                    i += 2
                if i < 0:
                    return None
    if scanned and b[i : i + 2] == b"\xff\xd9":
        return "image/jpeg", i + 2
    return None


def gif(b, at):
    if len(b) < at + 13:
        return None
    flags, i = b[at + 10], at + 13
    i += 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    def blocks(i):
        while i < len(b) and b[i]:
            i += 1 + b[i]
        return i + 1

    while i < len(b):
        if b[i] == 0x3B:
            return "image/gif", i + 1
        if b[i] == 0x21:
            i = blocks(i + 2)
        elif b[i] == 0x2C and i + 10 <= len(b):
            f = b[i + 9]
            i = blocks(i + 10 + (3 << ((f & 7) + 1) if f & 0x80 else 0) + 1)
        else:
            return None
    return None


def riff(b, at):
    if len(b) < at + 12:
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    kind = {b"WEBP": "image/webp", b"WAVE": "audio/wav", b"AVI ": "video/x-msvideo"}.get(b[at + 8 : at + 12])
    if kind is None or end > len(b) or end < at + 12:
        return None
    i = at + 12
    while i + 8 <= end:
        n = struct.unpack_from("<I", b, i + 4)[0]
        i += 8 + n + (n & 1)
    return (kind, min(end + (end - at & 1), len(b))) if i in (end, end + 1) else None


def bmp(b, at):
    if len(b) < at + 30:
        return None
    size, zero, offset, head = struct.unpack_from("<IIII", b, at + 2)
    planes, bits = struct.unpack_from("<HH", b, at + 26)
    ok = zero == 0 and head in (12, 40, 52, 56, 64, 108, 124) and 14 + head <= offset < size and at + size <= len(b)
    return ("image/bmp", at + size) if ok and (head == 12 or planes == 1 and bits in (1, 4, 8, 16, 24, 32)) else None


def tiff(b, at):
    e = "<" if b[at : at + 2] == b"II" else ">"
    end, seen = at + 8, set()
    if len(b) < end:
        return None
    width = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
    ifd = struct.unpack_from(e + "I", b, at + 4)[0]
    while ifd:
        if ifd in seen or ifd < 8 or at + ifd + 2 > len(b):
            return None
        seen.add(ifd)
        n = struct.unpack_from(e + "H", b, at + ifd)[0]
        if not n or at + ifd + 6 + 12 * n > len(b):
            return None
        tags = {}
        for k in range(n):
            tag, kind, count, value = struct.unpack_from(e + "HHII", b, at + ifd + 2 + 12 * k)
            if kind not in width:
                return None
            if (size := width[kind] * count) > 4:
                if at + value + size > len(b):
                    return None
                end = max(end, at + value + size)
            tags[tag] = (kind, count, value, at + ifd + 10 + 12 * k)
        for place, length in ((273, 279), (324, 325)):
            if place in tags and length in tags:
                where, sizes = ([struct.unpack_from(e + ("H" if kd == 3 else "I"), b, (p if width[kd] * c <= 4 else at + v) + width[kd] * j)[0] for j in range(c)] for kd, c, v, p in (tags[place], tags[length]) if kd in (3, 4))
                end = max([end, *(at + x + y for x, y in zip(where, sizes))])
        end = max(end, at + ifd + 6 + 12 * n)
        ifd = struct.unpack_from(e + "I", b, at + ifd + 2 + 12 * n)[0]
    return ("image/tiff", end) if seen and end <= len(b) else None


def ico(b, at):
    if len(b) < at + 22:
        return None
    n, end = struct.unpack_from("<H", b, at + 4)[0], 0
    if not 0 < n <= 64 or at + 6 + 16 * n > len(b):
        return None
    for k in range(n):
        zero, planes, _, size, offset = struct.unpack_from("<xxxBHHII", b, at + 6 + 16 * k)
        if zero or planes > 1 or size < 16 or offset < 6 + 16 * n or at + offset + size > len(b):
            return None
        head = b[at + offset : at + offset + 4]
        if head not in (b"\x89PNG", b"\x28\0\0\0"):
            return None
        end = max(end, at + offset + size)
    return "image/vnd.microsoft.icon", end


def pdf(b, at):
    if not re.match(rb"%PDF-\d\.\d", b[at : at + 8]):
        return None
    following = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, following if following > 0 else len(b))
    if end < 0 or b.find(b"startxref", at, end) < 0:
        return None
    end += 5
    while end < len(b) and b[end : end + 1] in (b"\r", b"\n"):
        end += 1
    return "application/pdf", end


def zipped(b, at):
    i = at
    while (i := b.find(b"PK\5\6", i + 1)) >= 0 and i + 22 <= len(b):
        entries, size, offset, comment = struct.unpack_from("<HIIH", b, i + 10)
        if at + offset + size == i and i + 22 + comment <= len(b):
            names, j = [], at + offset
            for _ in range(entries):
                if b[j : j + 4] != b"PK\1\2":
                    return None
                n, extra, note = struct.unpack_from("<HHH", b, j + 28)
                names.append(b[j + 46 : j + 46 + n])
                j += 46 + n + extra + note
            if j != i:
                return None
            kind = "application/zip"
            if any(n.startswith(b"word/") for n in names):
                kind = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
            elif any(n.startswith(b"xl/") for n in names):
                kind = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
            elif any(n.startswith(b"ppt/") for n in names):
                kind = "application/vnd.openxmlformats-officedocument.presentationml.presentation"
            elif b"META-INF/container.xml" in names:
                kind = "application/epub+zip"
            return kind, i + 22 + comment
    return None


def gzipped(b, at):
    if len(b) < at + 18 or b[at + 2] != 8 or b[at + 3] & 0xE0:
        return None
    z, i = zlib.decompressobj(31), at
    try:
        while i < len(b) and not z.eof:
            z.decompress(b[i : i + 65536])
            i += 65536
    except zlib.error:
        return None
    return ("application/gzip", min(i, len(b)) - len(z.unused_data)) if z.eof else None


RATES = {(3, 1): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), (2, 1): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}


def frames(b, at):
    """End and number of a chain of MPEG layer III frames."""
    i, n = at, 0
    while i + 4 <= len(b) and b[i] == 0xFF and b[i + 1] & 0xE0 == 0xE0:
        version, layer, rate, hz = b[i + 1] >> 3 & 3, b[i + 1] >> 1 & 3, b[i + 2] >> 4, b[i + 2] >> 2 & 3
        if version == 1 or layer != 1 or rate in (0, 15) or hz == 3:
            break
        per = (44100, 48000, 32000)[hz] // {3: 1, 2: 2, 0: 4}[version]
        size = (144 if version == 3 else 72) * RATES[(3 if version == 3 else 2, 1)][rate] * 1000 // per + (b[i + 2] >> 1 & 1)
        if i + size > len(b):
            break
        i, n = i + size, n + 1
    return i, n


def mp3(b, at):
    i = at
    if b[at : at + 3] == b"ID3":
        if len(b) < at + 10 or b[at + 3] > 4 or any(x & 0x80 for x in b[at + 6 : at + 10]):
            return None
        i = at + 10 + (b[at + 6] << 21 | b[at + 7] << 14 | b[at + 8] << 7 | b[at + 9])
    end, n = frames(b, i)
    return ("audio/mpeg", end) if n >= (1 if i > at else 3) else None


def ogg(b, at):
    i, last, n = at, False, 0
    while b[i : i + 5] == b"OggS\0" and i + 27 <= len(b) and not last:
        count = b[i + 26]
        end = i + 27 + count + sum(b[i + 27 : i + 27 + count])
        if end > len(b):
            return None
        last, i, n = bool(b[i + 5] & 4), end, n + 1
    kind = "video/ogg" if b[at : at + 300].find(b"theora") >= 0 else "audio/ogg"
    return (kind, i) if n and last else None


def flac(b, at):
    i, last = at + 4, False
    if b[i : i + 4] not in (b"\0\0\0\x22", b"\x80\0\0\x22"):
        return None
    while not last and i + 4 <= len(b):
        last = bool(b[i] & 0x80)
        i += 4 + int.from_bytes(b[i + 1 : i + 4], "big")
    return ("audio/flac", len(b)) if last and i < len(b) and b[i] == 0xFF and b[i + 1 : i + 2] and b[i + 1] & 0xFC == 0xF8 else None


def mp4(b, at):  # found by "ftyp", four bytes into the file
    i, kinds = at, []
    while i + 8 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, i)
        if n == 1 and i + 16 <= len(b):
            n = struct.unpack_from(">Q", b, i + 8)[0]
        elif n == 0:
            n = len(b) - i
        if n < 8 or i + n > len(b) or not re.fullmatch(rb"[\w \xa9-]{4}", kind):
            break
        kinds.append(kind)
        i += n
    if not kinds or kinds[0] != b"ftyp" or not {b"moov", b"moof", b"mdat", b"meta"} & set(kinds):
        return None
    brand = b[at + 8 : at + 12]
    if brand in (b"avif", b"avis"):
        return "image/avif", i
    if brand in (b"heic", b"heix", b"mif1"):
        return "image/heic", i
    return ("audio/mp4" if brand[:3] == b"M4A" else "video/quicktime" if brand == b"qt  " else "video/mp4"), i


def matroska(b, at):
    def number(i, keep=False):
        if i >= len(b) or not b[i]:
            return None, i
        n = 9 - b[i].bit_length()
        v = int.from_bytes(b[i : i + n], "big")
        if not keep:
            v &= (1 << 7 * n) - 1
            if v == (1 << 7 * n) - 1:
                v = -1  # unknown size: to the end
        return v, i + n

    size, i = number(at + 4)
    if size is None or size < 0 or i + size > len(b):
        return None
    head, i = b[i : i + size], i + size
    kind, j = number(i, keep=True)
    if kind != 0x18538067:
        return None
    size, j = number(j)
    end = len(b) if size == -1 else j + (size or 0)
    return ("video/webm" if b"webm" in head else "video/x-matroska", end) if size is not None and end <= len(b) else None


#: (magic, distance of the magic from the start, validator)
MAGICS = [
    (b"\x89PNG\r\n\x1a\n", 0, png),
    (b"\xff\xd8\xff", 0, jpeg),
    (b"GIF87a", 0, gif),
    (b"GIF89a", 0, gif),
    (b"RIFF", 0, riff),
    (b"BM", 0, bmp),
    (b"II*\0", 0, tiff),
    (b"MM\0*", 0, tiff),
    (b"\0\0\1\0", 0, ico),
    (b"%PDF-", 0, pdf),
    (b"PK\3\4", 0, zipped),
    (b"\x1f\x8b\x08", 0, gzipped),
    (b"ID3", 0, mp3),
    *((bytes([0xFF, x]), 0, mp3) for x in (0xFA, 0xFB, 0xF2, 0xF3, 0xE2, 0xE3)),
    (b"OggS\0", 0, ogg),
    (b"fLaC", 0, flac),
    (b"ftyp", 4, mp4),
    (b"\x1aE\xdf\xa3", 0, matroska),
]
MARKUP = (
    ("text/html", re.compile(rb"(?is)\s*(?:<!--.*?-->\s*)*<(?:!doctype\s+html|html|head|body)\b")),
    ("image/svg+xml", re.compile(rb"(?is)\s*(?:<\?xml[^>]*\?>\s*)?(?:<!--.*?-->\s*|<!doctype\s+svg[^>]*>\s*)*<svg\b")),
    ("application/xml", re.compile(rb"(?is)\s*<\?xml\s[^>]*\?>")),
)
DATA = re.compile(rb"data:([\w.+-]+/[\w.+-]+)?((?:;[\w-]+=[^;,\"'\s]*)*);base64,([A-Za-z0-9+/=\s%]+)")
#: Addresses with a type whose content is percent-encoded; it ends at the quote before it or, without one, at white space, quotes or brackets.
PERCENT = re.compile(rb"(?s)([\"'])?data:([\w.+-]+/[\w.+-]+)((?:;[\w-]+(?:=[^;,\"'\s]*)?)*),((?(1).*?(?=\1)|[^\s\"'<>()]+))")


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic, back, validator in MAGICS:
        a.add_word(magic.decode("latin-1"), (len(magic) - 1 + back, validator))
    a.make_automaton()
    return a


def confirmed(b: bytes) -> list[tuple[int, int, str]]:
    """(start, end, type) of every confirmed signature by position; each lies within another or outside it, and not in one of its own kind."""
    hits = sorted({(end - span, v.__name__): v for end, (span, v) in automaton().iter(b.decode("latin-1")) if end >= span}.items(), key=lambda x: x[0])
    out: list[tuple[int, int, str]] = []
    done: dict[str, int] = {}
    around: list[int] = []  # ends of those that hold the place, the innermost last
    i = 0
    while i < len(hits):
        start, best, name = hits[i][0][0], None, ""
        while around and around[-1] <= start:
            around.pop()
        while i < len(hits) and hits[i][0][0] == start:
            (_, kind), validator = hits[i]
            if start >= done.get(kind, 0) and (found := validator(b, start)):
                if around and found[1] > around[-1]:  # only one without an end of its own may end with what holds it
                    found = (found[0], around[-1]) if validator is flac else None
                if found and (best is None or found[1] > best[1]):
                    best, name = found, kind
            i += 1
        if best:
            out.append((start, best[1], best[0]))
            done[name] = best[1]
            around.append(best[1])
    return out


def addressed(blob: bytes, at: int) -> list[tuple[str, int, int, str]]:
    """The content of a data address, and the media inside it, all at the place of the address."""
    kind, _, inside = sniff(blob)
    return [(kind, at, len(blob), "data address"), *((k, at, n, "inside data address") for k, _, n, _ in inside)]


def sniff(b: bytes | None) -> tuple[str | None, int, list[tuple[str, int, int, str]]]:
    """Detected type, number of bytes confirmed, embedded media as (type, offset, length, how)."""
    if b is None:
        return None, 0, []
    if not b:
        return "empty", 0, []
    found = confirmed(b)
    if found and found[0][0] == 0:
        (_, length, kind), *rest = found
    else:
        rest, kind = found, next((k for k, p in MARKUP if p.match(b)), None)
        length = len(b) if kind else 0
    if kind is None:
        try:
            text = b.decode()
            kind = "text/plain" if not re.search(r"[\x00-\x08\x0e-\x1a\x1c-\x1f]", text) else "application/octet-stream"
        except UnicodeDecodeError:
            kind = "application/octet-stream"
    inside = [(k, s, e - s, "bytes") for s, e, k in rest]
    for m in DATA.finditer(b) if b.find(b";base64,") >= 0 else ():
        raw = re.sub(rb"\s|%0[aAdD]", b"", m[3]).replace(b"%2B", b"+").replace(b"%2F", b"/").replace(b"%3D", b"=").rstrip(b"=")
        try:
            blob = base64.b64decode(raw + b"=" * (-len(raw) % 4), validate=True)
        except (binascii.Error, ValueError):
            continue
        if blob:
            inside += addressed(blob, m.start(3))
    for m in PERCENT.finditer(b) if b.find(b"data:") >= 0 else ():
        if b";base64" not in m[3].lower() and (blob := unquote_to_bytes(m[4])):
            inside += addressed(blob, m.start(4))
    return kind, length, sorted(inside, key=lambda x: (x[1], x[2]))


SAME = {"image/jpg": "image/jpeg", "image/x-png": "image/png", "audio/x-wav": "audio/wav", "audio/wave": "audio/wav", "audio/mp3": "audio/mpeg", "image/x-icon": "image/vnd.microsoft.icon", "text/xml": "application/xml", "application/xhtml+xml": "text/html", "application/x-gzip": "application/gzip"}


def _sniffed():
    @F.pandas_udf("struct<detected:string,corrected:boolean,valid_bytes:long,embedded:array<struct<type:string,offset:int,length:int,how:string>>>")
    def sniffed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for blobs, declared in batches:
            rows = []
            for b, d in zip(blobs, declared):
                kind, length, inside = sniff(bytes(b) if b is not None else None)
                said = (d or "").split(";")[0].strip().lower()
                known = kind not in (None, "empty", "application/octet-stream")
                rows.append((kind, bool(known and SAME.get(said, said) != kind and not (kind == "text/plain" and said.startswith("text/"))), length, inside))
            yield pd.DataFrame(rows, columns=["detected", "corrected", "valid_bytes", "embedded"])

    return sniffed


def sniff_column(df: DataFrame, key: str, blob: Column | str = "content", declared: Column | str = "declared") -> DataFrame:
    """key, declared, n_bytes, detected, corrected, valid_bytes, embedded; one row for each input row.

    Columns given by name are found by exact spelling, the first of several, whatever else the table holds.
    """
    if isinstance(blob, str) and isinstance(declared, str):
        df, blob, declared = pick(df, key, blob, declared).toDF("__fl_k", "__fl_b", "__fl_d"), F.col("__fl_b"), F.col("__fl_d")
    else:
        blob, declared = (F.col(x) if isinstance(x, str) else x for x in (blob, declared))
        df = df.withColumn("__fl_k", F.col(key))
    d = df.select("__fl_k", blob.cast("binary").alias("__fl_b"), declared.cast("string").alias("declared"))
    d = d.select("__fl_k", "declared", F.length("__fl_b").cast("long").alias("n_bytes"), _sniffed()("__fl_b", "declared").alias("s"))
    return d.select(F.col("__fl_k").alias(key), "declared", "n_bytes", "s.detected", "s.corrected", "s.valid_bytes", "s.embedded")


def declared_by_address(url: Column) -> Column:
    """The media type that the address's file ending promises; pages without one are taken for HTML."""
    ending = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*/[^/?#]*\.([A-Za-z0-9]{1,5})(?:[?#].*)?$", 1))
    kinds = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "pdf": "application/pdf", "zip": "application/zip", "mp3": "audio/mpeg", "wav": "audio/wav", "mp4": "video/mp4", "txt": "text/plain", "xml": "application/xml"}
    out = F.when(F.lit(False), "")
    for k, v in kinds.items():
        out = out.when(ending == k, v)
    return out.otherwise("text/html")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's bytes, held against the type that its address promises."""
    pages = pick(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return sniff_column(pages, "page_id", F.col("html"), declared_by_address(F.col("url")))


QUERIES = {"op8_media_sniff": query}
