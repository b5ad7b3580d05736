"""Scans of files: extracted texts to findings, status, coverage and reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import RULES, Rule
from ..sources.files import MAX_TEXT
from ..sources.scratch import written
from . import redact, resolve, spans


def scan(files: DataFrame, keys: list[str], rules: tuple[Rule, ...] = RULES, terms: list[str] | None = None, limit: int = MAX_TEXT) -> DataFrame:
    """(keys, format, status, coverage, reason, secondary, n, kinds, outbound_text) of each file.

    files: keys, format and extracted (text, coverage, reason). A file that wasn't read, or whose text has over ``limit``
    bytes, is unscannable; one that asks for a review or wasn't wholly read is partial; else findings make it sensitive,
    and none clean. A review comes before the reason of the extraction, which then is secondary; of a PDF only its own
    reason is told, and never its text. outbound_text is the redacted text, null where nothing was found or a finding
    blocks. Allowlists and category policies belong to pages, so a scan takes none; nor hints. Keys tell files apart.
    """
    read = written(files.select(*keys, "format", "extracted.text", "extracted.coverage", "extracted.reason"), "extracted")
    long = F.octet_length("text") > limit
    texts = read.where((F.col("coverage") != "none") & ~long).select(*keys, "format", "text")
    selected = written(resolve.select_spans(spans.detect(texts, keys, "text", rules, terms), keys), "scanned")
    by = selected.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("policy") == "confirm").alias("asks"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    shown = texts.where("format <> 'pdf'").select(*keys, "text").join(by.select(*keys), keys, "left_semi")
    out = redact.redact(shown, selected, keys, keys).select(*keys, "outbound_text")
    n, review, none = F.coalesce("n", F.lit(0)), F.coalesce("asks", F.lit(0)) > 0, F.col("coverage") == "none"
    shut, part = none | long, review | (F.col("coverage") == "partial")
    told = F.when(none, F.col("reason")).when(long, "text_limit").when(review & (F.col("format") != "pdf"), "review_required").otherwise(F.col("reason"))
    second = F.when(~shut & review & (F.col("format") != "pdf"), F.col("reason"))
    return read.join(by, keys, "left").join(out, keys, "left").select(
        *keys, "format", F.when(shut, "unscannable").when(part, "partial").when(n > 0, "sensitive").otherwise("clean").alias("status"),
        F.when(shut, "none").when(part, "partial").otherwise("complete").alias("coverage"), told.alias("reason"), second.alias("secondary"),
        n.alias("n"), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"), "outbound_text",
    )
