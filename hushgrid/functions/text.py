"""Scalar text functions: canonical values, masks, context windows, markup, file formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import kinds

# Spoken digits, dash variants, blanks, file extensions, surrogate and mask labels.
SPOKEN, SPOKEN_AS = "零〇○一二三四五六七八九幺", "0001234567891"
DASHES = "‐‑‒–—―−﹘﹣－⁃"
BLANKS = "·・               　"
DROPPED = "­​‌‍‎‏‪‫‬‭‮⁠⁦⁧⁨⁩﻿"
TEXT_EXTENSIONS = ("txt", "md", "markdown", "csv", "tsv", "json", "jsonl", "log", "xml", "html", "htm", "yaml", "yml", "ini", "conf", "toml", "sql", "rtf", "env")
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "webp")
LABELS = {
    "phone": "手机号", "email": "邮箱", "china_id": "身份证号", "bank_card": "银行卡号", "person_name": "姓名", "address": "地址", "account": "账号", "passport": "护照号",
    "license_plate": "车牌号", "ipv4": "IP地址", "ipv6": "IP地址", "custom_term": "自定义词", "credential": "凭据", "api_key": "密钥", "access_token": "令牌",
}


def plain(text: Column) -> Column:
    """The part of the detection view that one-to-one replacement gives: dashes, blanks and full-width ASCII."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F) if chr(c) not in DASHES)
    narrow = "".join(chr(ord(c) - 0xFEE0) for c in wide)
    swapped = F.translate(text, DASHES + BLANKS + wide, "-" * len(DASHES) + " " * len(BLANKS) + narrow)
    return F.translate(swapped, DROPPED, "")


def canonical(kind: Column, raw: Column) -> Column:
    """The key under which values of a kind are one value."""
    flat = plain(raw)
    strip = lambda c, p: F.regexp_replace(c, p, "")
    date = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(raw), r"[年月日./-]", "-"), "-+", "-"), "^-|-$", "")
    return (
        F.when(kind.isin("phone", "bank_card"), strip(flat, r"[\s-]"))
        .when(kind == "email", F.lower(flat)).when(kind == "china_id", F.upper(raw))
        .when(kind.isin("passport", "license_plate"), F.upper(strip(flat, r"[\s·・]")))
        .when(kind == "mac_address", F.upper(strip(raw, "[:.-]"))).when(kind == "private_date", date)
        .when(kind.isin("person_name", "address"), strip(flat, r"[\s·・]")).when(kind == "account", strip(flat, "^@"))
        .when(kind.isin("api_key", "access_token", "unified_social_credit_code", "labeled_identifier", "credential", "private_url", "bank_account"), flat)
        .otherwise(raw)
    )


def spoken_number(text: Column) -> Column:
    """Spoken digits as ASCII, null if anything but digits and a last X remains."""
    out = F.translate(text, SPOKEN, SPOKEN_AS)
    return F.when(out.rlike("^[0-9]+[Xx]?$"), out)


def obfuscated_email(text: Column) -> Column:
    """The address behind usual spellings of its at sign and dots."""
    at = F.regexp_replace(text, r"(?i)\s*(?:_at_|\[at\]|\(at\)|艾特|\sat\s)\s*", "@")
    dot = F.regexp_replace(at, r"(?i)\s*(?:_dot_|\[dot\]|\(dot\)|\sdot\s)\s*", ".")
    return F.regexp_replace(dot, r"\s", "")


def compact_number(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s.·・-]", "")


def context(text: Column, start: Column, end: Column, radius: int = 32) -> Column:
    """``radius`` characters before a span, a blank, and as many after it."""
    before = F.substring(text, F.greatest(start - radius, F.lit(0)) + 1, F.least(start, F.lit(radius)))
    return F.concat(before, F.lit(" "), F.substring(text, end + 1, F.lit(radius)))


def mask(kind: Column, raw: Column) -> Column:
    """A value with its middle hidden, or the kind in angle brackets."""
    digits = F.regexp_replace(raw, r"\D", "")
    at = F.instr(raw, "@")
    name = F.concat(F.lit("<"), kind, F.lit(">"))
    return (
        F.when(kind == "phone", F.when(F.length(digits) >= 7, F.concat(F.left(digits, F.lit(3)), F.lit("****"), F.right(digits, F.lit(4)))).otherwise("<手机号>"))
        .when(kind == "email", F.when(at > 2, F.concat(F.left(raw, F.lit(1)), F.lit("***"), F.substring(raw, at, F.length(raw)))).otherwise("<邮箱>"))
        .when(kind.isin("china_id", "bank_card"), F.when(F.length(digits) >= 8, F.concat(F.left(digits, F.lit(4)), F.lit("********"), F.right(digits, F.lit(4)))).otherwise(name))
        .otherwise(name)
    )


def token(kind: Column, n: Column) -> Column:
    """``[[PREFIX_001]]``; numbers over 999 keep all their digits."""
    number = F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))
    return F.concat(F.lit("[["), kinds.prefix(kind), F.lit("_"), number, F.lit("]]"))


def surrogate(kind: Column, n: Column) -> Column:
    label = kind
    for k, v in LABELS.items():
        label = F.when(kind == k, F.lit(v)).otherwise(label)
    number = F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))
    return F.concat(F.lit("<"), label, F.lit("-"), number, F.lit(">"))


def markup_to_text(html: Column) -> Column:
    """Text of markup: tags become blanks, the five named entities characters (``&amp;`` last), blanks collapse."""
    out = F.regexp_replace(html, "<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def link_targets(html: Column) -> Column:
    """Values of link attributes, in order."""
    return F.regexp_extract_all(html, F.lit(r'(?i)\b(?:target|href|location|display)="([^"]*)"'), F.lit(1))


def file_format(name: Column) -> Column:
    """text, docx, xlsx, pdf, image or unknown by the extension."""
    ext = F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))
    return (
        F.when(ext.isin(*TEXT_EXTENSIONS), "text").when(ext.isin("docx", "xlsx", "pdf"), ext)
        .when(ext.isin(*IMAGE_EXTENSIONS), "image").otherwise("unknown")
    )


def ngrams(text: Column) -> Column:
    """Distinct single characters and pairs of a text without its blanks."""
    s = F.regexp_replace(text, r"\s", "")
    n = F.length(s)
    one = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(s, i, F.lit(1)))
    two = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2)))
    return F.when(n > 0, F.array_distinct(F.concat(one, F.when(n > 1, two).otherwise(F.array().cast("array<string>"))))).otherwise(F.array().cast("array<string>"))


def near_label(text: Column, start: Column, end: Column, pattern: str, radius: int = 24) -> Column:
    """Whether ``pattern`` is found within ``radius`` places of a span."""
    lo = F.greatest(start - radius, F.lit(0))
    return F.substring(text, lo + 1, end + radius - lo).rlike(pattern)


def overlaps_any(ranges: Column, start: Column, end: Column) -> Column:
    """Whether a span overlaps one of an array of ranges."""
    return F.coalesce(F.exists(ranges, lambda r: (start < r["end"]) & (r["start"] < end)), F.lit(False))


def clause_final(after: Column) -> Column:
    """Whether what follows a value, blanks aside, ends the clause."""
    return after.rlike(r"^[ \t\x{a0}·・]*(?:$|[，,。；;：:！？!、）)】\]\n\r])")
