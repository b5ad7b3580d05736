"""Office archives before they are opened: the central directory of a ZIP file as a column, checked by native expressions."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of an archive, and parts that hold nothing to read.
MAX_ENTRIES, MAX_UNPACKED, MAX_RATIO, MAX_PACKED_PART, MAX_TEXT = 2048, 64 << 20, 1000, 512 << 10, 2 << 20
STRUCTURE = ("[Content_Types].xml", "_rels/.rels")

FOLDERS = {"docx": "word", "xlsx": "xl"}
_END, _ENTRY = struct.Struct("<4s6xHIIH"), struct.Struct("<4s4xH10xIIHHH12x")
DIRECTORY = "total int, whole boolean, entries array<struct<name string, flags int, packed long, size long>>"


def is_text_part(name: str, form: str) -> bool:
    return bool(re.match(rf"(?:{FOLDERS[form]}|docProps|customXml)/", name) and re.search(r"(?i)\.(?:xml|rels)\Z", name))


def _entries(data: bytes, at: int, end: int, total: int) -> Iterator[tuple[str, int, int, int] | None]:
    """The directory's entries; a last None where one can't be read."""
    for _ in range(total):
        if at + _ENTRY.size > end:
            yield None
            return
        mark, flags, packed, size, name, extra, comment = _ENTRY.unpack_from(data, at)
        start, at = at + _ENTRY.size, at + _ENTRY.size + name + extra + comment
        if mark != b"PK\1\2" or at > end or 0xFFFFFFFF in (packed, size):
            yield None
            return
        yield data[start : start + name].decode("utf-8", "replace"), flags, packed, size


def read_directory(data: bytes | None) -> tuple[int | None, bool, list[tuple[str, int, int, int]]]:
    """(number of entries that the end record tells, whether all were read, entries); ZIP64 archives are not read.

    More than MAX_ENTRIES are not read either, as their number decides.
    """
    data = data or b""
    end = data.rfind(b"PK\5\6", max(0, len(data) - 65_557), max(0, len(data) - 18))
    if end < 0:
        return None, False, []
    _, total, size, start, _ = _END.unpack_from(data, end)
    if total == 0xFFFF or start == 0xFFFFFFFF or start + size > end:
        return None, False, []
    if total > MAX_ENTRIES:
        return total, True, []
    found = list(_entries(data, start, end, total))
    return (total, False, found[:-1]) if found and found[-1] is None else (total, True, found)


def directory(content: Column) -> Column:
    """total, whole and entries (name, flags, packed, size) of a ZIP file's central directory; total is null if there is none."""

    @F.pandas_udf(DIRECTORY)
    def read(data: pd.Series) -> pd.DataFrame:
        rows = [read_directory(d) for d in data]
        entries = [[dict(zip(("name", "flags", "packed", "size"), e)) for e in r[2]] for r in rows]
        return pd.DataFrame({"total": pd.array([r[0] for r in rows], dtype="Int32"), "whole": [r[1] for r in rows], "entries": entries})

    return read(content)


def text_part(name: Column, form: Column) -> Column:
    """Whether a part of a docx or xlsx is read as text."""
    folder = F.when(form == "docx", FOLDERS["docx"]).otherwise(FOLDERS["xlsx"])
    return (name.startswith(F.concat(folder, F.lit("/"))) | name.rlike("^(?:docProps|customXml)/")) & name.rlike(r"(?i)\.(?:xml|rels)$")


def unsafe_name(name: Column) -> Column:
    """Absolute, with a drive, or with a step upwards; either slash."""
    return name.rlike(r"^[\\/]|^[A-Za-z]:[\\/]|(?:^|[\\/])\.\.(?:$|[\\/])")


def fault(d: Column, form: Column) -> Column:
    """Why an archive isn't opened, from its directory alone: the reason of the first entry that has one; null if none has.

    parse_failed: no directory, ZIP64, a cut one, an unsafe or repeated name, an encrypted entry, size without data.
    text_limit: over 2,048 entries, over 64 MiB in all so far, over 1,000 times its packed size, a text part over 512 KiB
    packed, over 2 MiB of text parts so far.
    """
    def step(acc: Column, e: Column) -> Column:
        total, text = acc["total"] + e["size"], acc["text"] + F.when(text_part(e["name"], form), e["size"]).otherwise(0)
        broken = unsafe_name(e["name"]) | F.array_contains(acc["names"], e["name"]) | (e["flags"].bitwiseAND(1) == 1) | ((e["size"] > 0) & (e["packed"] == 0))
        wide = (e["size"] > e["packed"] * MAX_RATIO) | (total > MAX_UNPACKED) | (text_part(e["name"], form) & ((e["packed"] > MAX_PACKED_PART) | (text > MAX_TEXT)))
        why = F.when(acc["why"].isNotNull(), acc["why"]).when(broken, "parse_failed").when(wide, "text_limit")
        return F.struct(total.alias("total"), text.alias("text"), F.array_append(acc["names"], e["name"]).alias("names"), why.alias("why"))

    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("text"), F.array().cast("array<string>").alias("names"), F.lit(None).cast("string").alias("why"))
    first = F.aggregate(d["entries"], zero, step, lambda acc: acc["why"])
    return F.when(d["total"].isNull(), "parse_failed").when(d["total"] > MAX_ENTRIES, "text_limit").otherwise(F.coalesce(first, F.when(~d["whole"], "parse_failed")))
