"""Files: formats, limits, charsets, office archives, images. Bytes are read by Spark's binaryFile source."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import file_format
from . import archives

MAX_FILE, MAX_TEXT, MAX_PAGES, PROBE = 10 << 20, 2 << 20, 20, 32 << 10
#: What is trimmed from a page's text.
BLANKS = " \t\n\r\x0b\x0c\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
GOLD = "id string, text string, entities array<struct<start:int,end:int,label:string,text:string>>, source string, template_id string, template_family string"


def read_jsonl(spark: SparkSession, path: str, schema: str = GOLD) -> DataFrame:
    """Gold or prediction rows; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content, format and reason (file_limit, unsupported_format or null)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).withColumn("format", file_format(F.col("path")))
    return raw.withColumn("reason", refusal(F.col("length"), F.col("format")))


def refusal(length: Column, form: Column) -> Column:
    """Why a file isn't opened: file_limit, unsupported_format or null."""
    return F.when(length > MAX_FILE, "file_limit").when(form.isin("unknown", "image"), "unsupported_format")


def looks_binary(data: bytes) -> bool:
    """A NUL or over 2 % control bytes in the first 32 KiB; UTF-16 marks are text."""
    head = data[:PROBE]
    if not head or head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return False
    control = sum(b < 9 or 13 < b < 32 for b in head)
    return 0 in head or control > 0.02 * len(head)


def decode_text(data: bytes) -> str:
    """By mark, else UTF-16 if zero bytes stand on one side, else the better of UTF-8 and GB18030."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    pairs = max(1, len(data) // 2)
    even, odd = data[0::2].count(0), data[1::2].count(0)
    if odd >= 0.2 * pairs and odd > 2 * even:
        return data.decode("utf-16-le", "replace")
    if even >= 0.2 * pairs and even > 2 * odd:
        return data.decode("utf-16-be", "replace")
    utf8, gb = data.decode("utf-8", "replace"), data.decode("gb18030", "replace")
    return gb if gb.count("�") < utf8.count("�") else utf8


def truncate_utf8(text: str, limit: int) -> str:
    """At most ``limit`` bytes of UTF-8, whole characters."""
    return text.encode()[:limit].decode("utf-8", "ignore")


def _markup(xml: str) -> str:
    links = re.findall(r'(?i)\b(?:target|href|location|display)="([^"]*)"', xml)
    flat = re.sub(r"<[^>]*>", " ", " ".join([*links, xml]))
    flat = re.sub(r"&#(x?)([0-9A-Fa-f]+);", lambda m: chr(min(int(m[2], 16 if m[1] else 10), 0x10FFFF)), flat)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        flat = flat.replace(entity, char)
    return re.sub(r"\s+", " ", flat).strip()


def office_text(data: bytes, form: str, entries: list[str]) -> tuple[str | None, str, str | None]:
    """(text, coverage, reason) of the listed parts of an archive that its directory has passed for."""
    parts, size = [], 0
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        readable = [n for n in z.namelist() if not n.endswith("/")]
        wanted = [n for n in readable if n in set(entries) and archives.is_text_part(n, form)]
        for name in wanted:
            parts.append(_markup(z.read(name).decode("utf-8", "replace")))
            size += len(parts[-1].encode())
            if size > MAX_TEXT:
                return None, "none", "text_limit"
    if not wanted:
        return None, "none", "parse_failed"
    other = any(n not in wanted and n not in archives.STRUCTURE for n in readable)
    return "\n\n".join(p for p in parts if p), "partial" if other else "complete", "embedded_media" if other else None


def image_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) from a PNG, JPEG or WebP header."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
        if data[12:16] == b"VP8 ":
            w, h = struct.unpack("<HH", data[26:30])
            return w & 0x3FFF, h & 0x3FFF
        if data[12:16] == b"VP8L":
            n = int.from_bytes(data[21:25], "little")
            return (n & 0x3FFF) + 1, (n >> 14 & 0x3FFF) + 1
    for kind, at, size in _jpeg_segments(data):
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC) and size >= 7:
            h, w = struct.unpack(">HH", data[at + 1 : at + 5])
            return w, h
    return None


def _jpeg_segments(data: bytes):
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        yield data[at + 1], at + 4, size - 2
        if size < 2 or data[at + 1] == 0xDA:
            return
        at += 2 + size


def upright(data: bytes) -> bool:
    """No EXIF orientation, or the normal one."""
    for kind, at, size in _jpeg_segments(data):
        exif = data[at : at + size]
        if kind == 0xE1 and exif[:6] == b"Exif\0\0" and len(exif) >= 14:
            order = "<" if exif[6:8] == b"II" else ">"
            first = struct.unpack(order + "I", exif[10:14])[0] + 6
            count = struct.unpack(order + "H", exif[first : first + 2])[0] if first + 2 <= len(exif) else 0
            for k in range(count):
                e = exif[first + 2 + 12 * k : first + 14 + 12 * k]
                if len(e) == 12 and struct.unpack(order + "H", e[:2])[0] == 0x0112:
                    return struct.unpack(order + "H", e[8:10])[0] == 1
    return True


EXTRACTED = T.StructType([T.StructField("text", T.StringType()), T.StructField("coverage", T.StringType()), T.StructField("reason", T.StringType())])


def extract(files: DataFrame, keys: list[str] = ["path"], pages: DataFrame | None = None) -> DataFrame:
    """``files`` (keys, content, format, reason) with extracted: text, coverage (complete, partial, none) and reason.

    Archives are opened only where their directory passes. PDF texts come from ``pages`` (keys, page from 1, text,
    failed); a file without pages has no text layer. Null content is parse_failed.
    """

    @F.pandas_udf(EXTRACTED)
    def read(content: pd.Series, form: pd.Series, reason: pd.Series, entries: pd.Series) -> pd.DataFrame:
        rows = []
        for data, kind, why, names in zip(content, form, reason, entries):
            if why or data is None:
                rows.append((None, "none", why or "parse_failed"))
            elif kind == "text":
                rows.append((None, "none", "parse_failed") if looks_binary(data) else (decode_text(data), "complete", None))
            else:
                try:
                    rows.append(office_text(data, kind, list(names)))
                except (zipfile.BadZipFile, zlib.error, ValueError, NotImplementedError, OSError, EOFError, RuntimeError, KeyError):
                    rows.append((None, "none", "parse_failed"))
        return pd.DataFrame(rows, columns=["text", "coverage", "reason"])

    office = F.col("format").isin("docx", "xlsx")
    seen = files.withColumn("_dir", F.when(office & F.col("reason").isNull(), archives.directory(F.col("content"))))
    why = F.coalesce(F.col("reason"), F.when(office, archives.fault(F.col("_dir"), F.col("format"))))
    asked = seen.withColumn("_why", why).withColumn("_names", F.transform("_dir.entries", lambda e: e["name"]))
    pdf = (F.col("format") == "pdf") & F.col("_why").isNull()
    out = asked.where(~pdf).withColumn("extracted", read("content", "format", "_why", "_names"))
    layer = asked.where(pdf)
    if pages is None:
        told = layer.withColumn("extracted", F.struct(F.lit("").alias("text"), F.lit("partial").alias("coverage"), F.lit("pdf_without_text").alias("reason")))
    else:
        found = page_texts(pages, keys).select(*keys, F.struct("text", "coverage", "reason").alias("_found"))
        none = F.struct(F.lit("").alias("text"), F.lit("partial").alias("coverage"), F.lit("pdf_without_text").alias("reason"))
        told = layer.join(found, keys, "left").withColumn("extracted", F.coalesce("_found", none)).drop("_found")
    return out.unionByName(told).drop("_dir", "_why", "_names")


def _cut(text: Column, limit: Column) -> Column:
    """At most ``limit`` bytes of UTF-8, whole characters: back from the limit over bytes that go on with a character."""
    data = F.encode(text, "UTF-8")
    goes_on = lambda at: F.hex(F.substring(data, at + 1, F.lit(1))).between("80", "BF")
    at = F.when(~goes_on(limit), limit).when(~goes_on(limit - 1), limit - 1).when(~goes_on(limit - 2), limit - 2).otherwise(limit - 3)
    return F.when(F.octet_length(text) <= limit, text).when(limit <= 0, "").otherwise(F.decode(F.substring(data, F.lit(1), at), "UTF-8"))


def page_texts(pages: DataFrame, keys: list[str], limit: int = MAX_TEXT, most: int = MAX_PAGES) -> DataFrame:
    """(keys, text, coverage, reason, pages_with_text, pages_without_text) of files from their page texts.

    pages: keys, page (from 1), text, failed. Pages go in order until one fails or the byte budget ends within it, ``most``
    at best; blank ones add nothing. The text layer never covers a file, so coverage is partial. Reasons, strongest
    first: text_limit, parse_failed, page_limit, pdf_without_text, pdf_text_layer_only.
    """
    t = F.btrim(F.coalesce("text", F.lit("")), F.lit(BLANKS))
    first = pages.where(F.col("page") <= most).select(*keys, "page", t.alias("t"), F.coalesce("failed", F.lit(False)).alias("failed"))
    w = Window.partitionBy(*keys).orderBy("page", "t")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    told = first.withColumn("t", F.when(F.col("failed"), "").otherwise(F.col("t"))).withColumn("size", F.octet_length("t").cast("long"))
    told = told.withColumn("gap", F.when((F.col("size") > 0) & (F.coalesce(F.sum("size").over(before), F.lit(0)) > 0), 2).otherwise(0))
    told = told.withColumn("room", F.lit(limit) - F.coalesce(F.sum(F.col("size") + F.col("gap")).over(before), F.lit(0)) - F.col("gap"))
    told = told.withColumn("over", (F.col("size") > 0) & (F.col("size") > F.col("room")))
    told = told.withColumn("late", F.coalesce(F.bool_or(F.col("over") | F.col("failed")).over(before), F.lit(False))).where("not late")
    part = _cut(F.col("t"), F.col("room").cast("int"))
    put = told.withColumn("part", part).withColumn("part", F.when(F.col("part") != "", F.concat(F.when(F.col("gap") > 0, "\n\n").otherwise(""), "part")).otherwise(""))
    by = put.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t", "part"))), lambda x: x["part"]), "").alias("text"),
        F.bool_or("over").alias("over"), F.bool_or("failed").alias("failed"), F.count("*").alias("done"), F.count_if(F.col("size") > 0).alias("pages_with_text"),
        F.count_if((F.col("size") == 0) & ~F.col("failed")).alias("blank"),
    )
    all_ = pages.groupBy(*keys).agg(F.count("*").alias("n"))
    skipped = F.col("n") - F.coalesce("done", F.lit(0))
    reason = (
        F.when(F.col("over"), "text_limit").when(F.col("failed"), "parse_failed").when(skipped > 0, "page_limit")
        .when(F.col("pages_with_text") == 0, "pdf_without_text").otherwise("pdf_text_layer_only")
    )
    out = all_.join(by, keys, "left")
    return out.select(*keys, F.coalesce("text", F.lit("")).alias("text"), F.lit("partial").alias("coverage"), reason.alias("reason"), F.coalesce("pages_with_text", F.lit(0)).alias("pages_with_text"), (F.coalesce("blank", F.lit(0)) + skipped).alias("pages_without_text"))
