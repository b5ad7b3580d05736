"""Summaries: findings, confirmation texts, audit, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import kinds
from . import resolve


def findings(selected: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each document and kind: n, inferred, decision and policy of the highest rank, first place, and a warning if a span has one."""
    r = resolve.rank(F.col("policy"), F.col("decision"))
    top = F.max_by(F.struct("decision", "policy"), F.struct(r.alias("r"), (-F.col("start")).alias("s")))
    warning = F.max("warning") if "warning" in selected.columns else F.lit(None).cast("string")
    return selected.groupBy(*keys, "kind").agg(
        F.count("*").alias("n"), F.bool_or(resolve.inferred(F.col("kind"), F.col("source"))).alias("inferred"), top.alias("top"), F.min("start").alias("first_start"), warning.alias("warning")
    ).select(*keys, "kind", "n", "inferred", "top.decision", "top.policy", "first_start", "warning")


def confirmation_text(found: DataFrame, keys: list[str]) -> DataFrame:
    """``kind n 项`` joined by ``，`` in the order of first places."""
    part = F.struct("first_start", "kind", F.concat(F.col("kind"), F.lit(" "), F.col("n").cast("string"), F.lit(" 项")).alias("t"))
    return found.groupBy(*keys).agg(F.concat_ws("，", F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"])).alias("message"))


def summary(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, n, labels, inferred): findings of several texts put together; labels distinct, in order."""
    return found.groupBy(*keys, "kind").agg(F.sum("n").alias("n"), F.concat_ws(",", F.array_sort(F.collect_set("label"))).alias("labels"), F.bool_or("inferred").alias("inferred"))


def run_stats(docs: DataFrame, hints: str, ms: str) -> DataFrame:
    """(documents, primed, hints, ms_per_document) of an evaluation run; primed ones have a hint."""
    return docs.agg(F.count("*").alias("documents"), F.count_if(F.col(hints) > 0).alias("primed"), F.sum(hints).alias("hints"), F.avg(ms).alias("ms_per_document"))


def examples(spans: DataFrame, by: list[str], order: list[str], n: int = 8) -> DataFrame:
    """The first ``n`` spans of each group."""
    return spans.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def merge_counts(found: DataFrame, keys: list[str]) -> DataFrame:
    """Repeated kinds summed; unknown kinds, nulls and counts under one left out."""
    return found.where(F.col("kind").isin(*kinds.NAMES) & (F.col("n") >= 1)).groupBy(*keys, "kind").agg(F.sum("n").alias("n"))


def dropped_kinds(found: DataFrame) -> DataFrame:
    """(kind, n) of the kinds that evaluation has no label for."""
    table = kinds.kind_table(found.sparkSession)
    return found.join(table.select("kind", "eval_label"), "kind", "left").where("eval_label is null").groupBy("kind").agg(F.count("*").alias("n"))


def audit_tail(events: DataFrame, at: str, tie: str, keep: int = kinds.MAX_AUDIT) -> DataFrame:
    """The last ``keep`` events."""
    return events.orderBy(F.col(at).desc(), F.col(tie).desc()).limit(keep)


def audit_hash(events: DataFrame, columns: list[str]) -> DataFrame:
    """Events with the SHA-256 of their canonical JSON: names sorted, times left out."""
    return events.withColumn("content_hash", F.sha2(F.to_json(F.struct(*sorted(columns))), 256))


#: Places by which an approximate percentile may be off, as a share of the rows.
SLACK = 1e-4


def percentile_at(values: DataFrame, group: list[str], value: str, q: float) -> DataFrame:
    """The element at floor(n q) of the sorted values, the last at most. Nulls are left out.

    Approximate percentiles bracket it; only the few rows within the bracket are put in order.
    """
    known = values.where(F.col(value).isNotNull())
    near = lambda at: F.percentile_approx(value, min(max(at, 0.0), 1.0), int(2 / SLACK))
    box = known.groupBy(*group).agg(F.count("*").alias("_n"), near(q - 2 * SLACK).alias("_lo"), near(q + 2 * SLACK).alias("_hi"))
    placed = known.join(box, group)
    below = placed.groupBy(*group).agg(F.count_if(F.col(value) < F.col("_lo")).alias("_below"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(value)) - 1 + F.col("_below")
    inside = placed.where(F.col(value).between(F.col("_lo"), F.col("_hi"))).join(below, group).withColumn("_place", place)
    at = F.least(F.floor(F.col("_n") * q), F.col("_n") - 1)
    return inside.where(F.col("_place") == at).select(*group, F.col(value).alias("value"))
