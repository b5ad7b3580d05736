"""Registered queries of file scans: archive checks, page texts, files from bytes to status, each with its SQL."""

from __future__ import annotations

import io
import struct
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scans
from ..sources import files
from .catalog import TOLD, register, t
from .found import found_sql

_TRIM = " || ".join(f"chr({ord(c)})" for c in files.BLANKS)
#: What the extraction of markup takes for blanks.
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def archive(parts: list[tuple[str, str]]) -> bytes:
    """An archive of text parts; a name may repeat."""
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts:
            z.writestr(zipfile.ZipInfo(name), text)
    return buf.getvalue()


def patched(data: bytes, entry: int | None, at: int, form: str, *values: int) -> bytes:
    """``data`` with numbers of a directory entry changed, or of the end record where ``entry`` is None."""
    place = data.rfind(b"PK\5\6") if entry is None else [i for i in range(len(data)) if data.startswith(b"PK\1\2", i)][entry]
    out = bytearray(data)
    struct.pack_into(form, out, place + at, *values)
    return bytes(out)


def broken_archive(k: int) -> bytes:
    """A docx whose directory has the k-th fault of ``FAULTS``."""
    good = archive([("word/document.xml", f"<t>{k}</t>"), ("word/media/a.png", "x" * 9)])
    sizes = {5: (1, 1, 1001), 6: (0, 600_000, 600_000), 7: (1, 1 << 20, (64 << 20) + 1), 8: (0, 100_000, (2 << 20) + 1)}
    match k % len(FAULTS):
        case 1:
            return archive([("word/document.xml", "a"), ("word/../../x.xml", "b")])
        case 2:
            return patched(archive([("word/document.xml", "a"), ("word/documenu.xml", "b")]), 1, 46 + 12, "<B", ord("t"))
        case 3:
            return patched(good, 0, 8, "<H", 1)
        case 4:
            return patched(good, 1, 20, "<II", 0, 9)
        case 5 | 6 | 7 | 8 as n:
            return patched(good, sizes[n][0], 20, "<II", *sizes[n][1:])
        case 9:
            return patched(good, None, 10, "<H", 0xFFFF)
        case 10:
            return patched(good, None, 16, "<I", len(good))
        case 11:
            return patched(good, None, 10, "<H", 3000)
        case 12:
            return b"no archive"
        case 13:
            return archive([("xl/sheet.xml", "a")])
        case 14:
            return patched(good, 0, 24, "<I", 0xFFFFFFFF)
        case 15:
            return archive([("C:\\word\\a.xml", "a")])
    return good


# What each fault comes to: a step upwards, a repeated name, encryption, size without data, ratio, packed part, total,
# text in all, ZIP64 by number, directory outside, entries, no archive, no text part, ZIP64 by size, a drive.
FAULTS = (None, *["parse_failed"] * 4, *["text_limit"] * 4, "parse_failed", "parse_failed", "text_limit", *["parse_failed"] * 4)


@register("archive_checks", f"""select c_custkey as k, case when c_custkey % {len(FAULTS)} = 0 then 'partial' else 'none' end as coverage,
    case c_custkey % {len(FAULTS)} when 0 then 'embedded_media' {' '.join(f"when {i} then '{r}'" for i, r in enumerate(FAULTS) if r)} end as reason from customer""")
def archive_checks(spark, sf_dir):
    """An archive for each customer, all but one in sixteen with a fault in its directory: why it isn't opened."""

    @F.pandas_udf("binary")
    def made(k: pd.Series) -> pd.Series:
        return k.map(broken_archive)

    k = F.col("c_custkey")
    given = t(spark, sf_dir, "customer").select(k.alias("k"), made(k).alias("content"), F.lit("docx").alias("format"), F.lit(None).cast("string").alias("reason"))
    return files.extract(given, ["k"]).select("k", "extracted.coverage", "extracted.reason")


def _pages(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, page, text: pieces of ``size`` characters."""
    n = F.greatest(F.ceil(F.length("text") / F.lit(size)), F.lit(1)).cast("int")
    return docs.select("doc_id", "text", F.explode(F.sequence(F.lit(1), n)).alias("page")).select("doc_id", "page", F.substring("text", (F.col("page") - 1) * size + 1, F.lit(size)).alias("text"))


def _pages_sql(table: str, size: int) -> str:
    return f"(select doc_id, page, substr(text, (page - 1) * {size} + 1, {size}) as text from (select doc_id, text, unnest(range(1, greatest(ceil(length(text) / {size}), 1)::int + 1)) as page from {table}))"


@register("page_texts", f"""
    with p as (select doc_id, page, doc_id % 97 = 5 and page = 3 as failed, case when (doc_id + page) % 11 = 3 or doc_id % 50 = 7 or (doc_id % 97 = 5 and page = 3) then '' else trim(text, {_TRIM}) end as t from {_pages_sql("documents", 300)}),
      s as (select *, octet_length(encode(t)) as size from p where page <= 20),
      g as (select *, size + case when size > 0 and bool_or(size > 0) over (partition by doc_id order by page rows between unbounded preceding and 1 preceding) then 2 else 0 end as cost from s),
      r as (select *, sum(cost) over (partition by doc_id order by page) as upto from g),
      e as (select doc_id, coalesce(min(page) filter (where failed or (size > 0 and upto > 4000)), 21) as last from r group by 1),
      u as (select r.*, case when size = 0 then '' else
          case when cost > size and left_of(t, 4000 - (upto - size)) <> '' then chr(10) || chr(10) else '' end || left_of(t, 4000 - (upto - size)) end as part, size > 0 and upto > 4000 as over from r join e using (doc_id) where page <= last),
      a as (select doc_id, string_agg(part, '' order by page) as text, bool_or(over) as over, bool_or(failed) as failed, count(*) as done, count(*) filter (where size > 0) as filled, count(*) filter (where size = 0 and not failed) as blank from u group by 1),
      n as (select doc_id, count(*) as n from p group by 1)
    select doc_id, text, case when over then 'text_limit' when failed then 'parse_failed' when n > done then 'page_limit' when filled = 0 then 'pdf_without_text' else 'pdf_text_layer_only' end as reason,
      filled as pages_with_text, blank + n - done as pages_without_text from a join n using (doc_id)""".replace(
    "left_of(t, 4000 - (upto - size))", "coalesce(left(t, list_max(list_filter(range(0, 301), lambda k: octet_length(encode(left(t, k))) <= 4000 - (upto - size)))), '')"))
def page_texts(spark, sf_dir):
    """Documents as page texts, some blank, some unreadable, under a budget of 4,000 bytes."""
    d, p = F.col("doc_id"), F.col("page")
    pages = _pages(t(spark, sf_dir, "documents"), 300).withColumn("text", F.when(((d + p) % 11 == 3) | (d % 50 == 7), F.lit(" \n\u3000")).otherwise(F.col("text"))).withColumn("failed", (d % 97 == 5) & (p == 3))
    return files.page_texts(pages, ["doc_id"], 4000).drop("coverage")


_HELLO = "我叫李建国，你好。"
_NAMES = ("a.txt", "b.md", "c.docx", "d.xlsx", "e.pdf", "f.docx", "g.bin", "h.log")
_FORMATS = ("text", "text", "docx", "xlsx", "pdf", "docx", "unknown", "text")


@register("file_scans", f"""
    with given as (select doc_id, case when doc_id // 8 % 4 = 0 then '{_HELLO}' || chr(10) else '' end || text as text from documents),
      paged as (select doc_id, count(*) as pages, string_agg(x, chr(10) || chr(10) order by page) filter (where page <= 20 and x <> '') as text
        from (select doc_id, page, trim(text, {_TRIM}) as x from {_pages_sql("given", 1500)} where doc_id % 8 = 4) group by 1),
      texts as (select doc_id, text from given where doc_id % 8 < 2 union all select doc_id, trim(regexp_replace(text, '{_SPACE}', ' ', 'g')) from given where doc_id % 8 in (2, 3) union all select doc_id, coalesce(text, '') from paged),
      {found_sql("texts")},
      k as (select doc_id, kind, normalized, row_number() over (partition by doc_id, kind order by first_at, normalized) as n from (select doc_id, kind, normalized, min(start_) as first_at from found group by all)),
      f as (select doc_id, kind, decision, length('[[' || case kind when 'email' then 'EMAIL' when 'ipv4' then 'IPV4' when 'bank_card' then 'BANK_CARD' else 'CREDENTIAL' end || '_' || case when n < 1000 then lpad(n::varchar, 3, '0') else n::varchar end || ']]') - (end_ - start_) as more
          from found join k using (doc_id, kind, normalized)
        union all select doc_id, 'person_name', 'replace', 11 from texts where doc_id // 8 % 4 = 0),
      s as (select doc_id, count(*) as n, string_agg(distinct kind, ',' order by kind) as kinds, bool_or(kind = 'person_name') as asks, bool_or(decision = 'block') as blocks, sum(more) as more from f group by 1),
      j as (select g.doc_id, g.doc_id % 8 as m, coalesce(n, 0) as n, coalesce(kinds, '') as kinds, coalesce(asks, false) as asks, blocks, more, length(x.text) as len,
        case g.doc_id % 8 when 3 then 'embedded_media' when 4 then case when pages > 20 then 'page_limit' when coalesce(p.text, '') = '' then 'pdf_without_text' else 'pdf_text_layer_only' end
          when 5 then 'parse_failed' when 6 then 'unsupported_format' when 7 then 'parse_failed' end as why
        from given g left join s using (doc_id) left join texts x using (doc_id) left join paged p using (doc_id))
    select doc_id, case m {' '.join(f"when {i} then '{x}'" for i, x in enumerate(_FORMATS))} end as format,
      case when m > 4 then 'unscannable' when m in (3, 4) or asks then 'partial' when n > 0 then 'sensitive' else 'clean' end as status,
      case when m > 4 then 'none' when m in (3, 4) or asks then 'partial' else 'complete' end as coverage,
      case when asks and m < 4 then 'review_required' else why end as reason, case when asks and m < 4 then why end as secondary, n, kinds,
      case when m < 4 and n > 0 and not blocks then (len + more)::int end as outbound_length from j""")
def file_scans(spark, sf_dir):
    """Documents as files of eight forms (two charsets, docx, xlsx with an image, PDF pages, a broken archive, a binary and an unknown one), scanned from bytes to status."""
    d = F.col("doc_id")
    m = (d % 8).cast("int")
    given = t(spark, sf_dir, "documents").select("doc_id", F.concat(F.when(F.floor(d / 8) % 4 == 0, _HELLO + "\n").otherwise(""), "text").alias("text"))

    @F.pandas_udf("binary")
    def office(text: pd.Series, form: pd.Series) -> pd.Series:
        def made(x: str, xlsx: bool) -> bytes:
            body = ("xl/sharedStrings.xml" if xlsx else "word/document.xml", f"<t>{escape(x, {chr(34): '&quot;'})}</t>")
            return archive([("[Content_Types].xml", "<Types/>"), ("_rels/.rels", "<Relationships/>"), body, *([("xl/media/a.png", "x")] if xlsx else [])])

        return pd.Series([made(x, f == "xlsx") for x, f in zip(text, form)])

    name = F.element_at(F.array(*map(F.lit, _NAMES)), m + 1)
    plain = F.encode("text", "UTF-8")
    content = (
        F.when(m == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).when(m == 5, F.encode(F.lit("PK no archive"), "UTF-8"))
        .when(m == 7, F.concat(F.unhex(F.lit("00")), plain)).otherwise(plain)
    )
    base = given.withColumn("format", files.file_format(name))
    simple = base.where(~m.isin(2, 3)).withColumn("content", content)
    zipped = base.where(m.isin(2, 3)).withColumn("content", office("text", "format"))
    every = simple.unionByName(zipped).withColumn("length", F.octet_length("content"))
    given_files = every.select("doc_id", "format", "content", files.refusal(F.col("length"), F.col("format")).alias("reason"))
    pages = _pages(given.where(m == 4), 1500).withColumn("failed", F.lit(False))
    out = scans.scan(files.extract(given_files, ["doc_id"], pages), ["doc_id"], TOLD)
    return out.select("doc_id", "format", "status", "coverage", "reason", "secondary", "n", F.array_join("kinds", ",").alias("kinds"), F.length("outbound_text").alias("outbound_length"))
