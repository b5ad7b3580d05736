"""Words of a page image: normalization, coverage, rectangles, scan status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import kinds
from .resolve import overlap_join

PADDING, SURE, MAX_SIDE, MAX_PIXELS = 3, 55, 16_384, 12_000_000


def normalize_words(words: DataFrame) -> DataFrame:
    """Words (text, confidence, x0, y0, x1, y1, width, height) trimmed, clamped to the image; bad ones dropped."""
    t = F.left(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit(kinds.MAX_OCR_TEXT))
    clamp = lambda c, hi: F.least(F.greatest(F.col(c), F.lit(0.0)), F.col(hi).cast("double"))
    out = words.withColumn("text", t)
    for c, hi in (("x0", "width"), ("x1", "width"), ("y0", "height"), ("y1", "height")):
        out = out.withColumn(c, clamp(c, hi))
    return out.withColumn("confidence", F.least(F.greatest("confidence", F.lit(0.0)), F.lit(100.0))).where((F.col("text") != "") & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))


def coverage(words: DataFrame, page: list[str]) -> DataFrame:
    """(page, complete): whether every word of a page is sure and none was cut off."""
    return words.groupBy(*page).agg(((F.count("*") <= kinds.MAX_OCR_WORDS) & (F.min("confidence") >= SURE)).alias("complete"))


def _fits(before: Column, now: Column) -> Column:
    """Whether a word goes on in the visual row of the word before."""
    height = F.greatest(before["y1"] - before["y0"], now["y1"] - now["y0"])
    gap = now["x0"] - before["x1"]
    return (F.abs((before["y0"] + before["y1"]) / 2 - (now["y0"] + now["y1"]) / 2) <= height * 0.75) & (gap >= height * -0.25) & (gap <= height * 2)


def joined_words(words: DataFrame, page: list[str], order: str) -> DataFrame:
    """(page, text, compact): words of a page joined by blanks within a visual row and by line ends between rows; in the
    compact text Han and identifier characters of one row touch."""
    w = Window.partitionBy(*page).orderBy(order)
    box = F.struct("x0", "y0", "x1", "y1")
    told = words.withColumn("_now", box).withColumn("_before", F.lag(box).over(w)).withColumn("_last", F.right(F.lag("text").over(w), F.lit(1)))
    fits = F.coalesce(_fits(F.col("_before"), F.col("_now")), F.lit(False))
    touch = lambda chars: F.col("_last").rlike(chars) & F.left("text", F.lit(1)).rlike(chars)
    close = fits & (touch(r"[\x{3400}-\x{9fff}]") | touch(r"[A-Za-z0-9@._:+/-]"))
    gap = F.when(F.col("_before").isNull(), "").when(fits, " ").otherwise("\n")
    part = told.withColumn("_t", F.concat(gap, "text")).withColumn("_c", F.concat(F.when(close, "").otherwise(gap), "text"))
    text = lambda c: F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda x: x[c]))
    return part.groupBy(*page).agg(text("_t").alias("text"), text("_c").alias("compact"))


def extra_ranges(compact: DataFrame, primary: DataFrame, page: list[str]) -> DataFrame:
    """Spans of the compact text that no span of the same kind in the primary text overlaps."""
    return overlap_join(compact, primary, [*page, "kind"], "left_anti")


def rectangles(spans: DataFrame, words: DataFrame, page: list[str]) -> DataFrame:
    """Box around the words that each span overlaps. spans: page, start, end; words: page, w_start, w_end and a box."""
    j = spans.join(words, page).where((F.col("start") < F.col("w_end")) & (F.col("w_start") < F.col("end")))
    return j.groupBy(*page, "start", "end").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def padded(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """The filled rectangle of a box: whole pixels outward, padded, within the image; null if nothing is left."""
    lo = lambda c: F.greatest(F.floor(c) - PADDING, F.lit(0)).cast("long")
    hi = lambda c, most: F.least(F.ceil(c) + PADDING, most).cast("long")
    w, h = hi(x1, width) - lo(x0), hi(y1, height) - lo(y0)
    return F.when((w > 0) & (h > 0), F.struct(lo(x0).alias("x"), lo(y0).alias("y"), w.alias("w"), h.alias("h")))


def image_status(width: Column, height: Column, words: Column, complete: Column, findings: Column) -> Column:
    """unscannable, partial, sensitive or clean."""
    return (
        F.when((width > MAX_SIDE) | (height > MAX_SIDE) | (width.cast("long") * height > MAX_PIXELS), "unscannable")
        .when((words == 0) | ~complete, "partial").when(findings > 0, "sensitive").otherwise("clean")
    )


def text_status(octets: Column, asks: Column, findings: Column, limit: int) -> Column:
    """Status of a plain text scan."""
    return F.when(octets > limit, "unscannable").when(asks > 0, "partial").when(findings > 0, "sensitive").otherwise("clean")


# Scan reasons, strongest first.
REASONS = ("text_limit", "parse_failed", "page_limit", "pdf_without_text", "pdf_text_layer_only")


def reason_order(reasons: Column) -> Column:
    """(reason, secondary): the two strongest of an array of reasons; unknown and repeated ones left out."""
    found = F.filter(F.array(*map(F.lit, REASONS)), lambda r: F.array_contains(reasons, r))
    return F.struct(F.get(found, F.lit(0)).alias("reason"), F.get(found, F.lit(1)).alias("secondary"))
