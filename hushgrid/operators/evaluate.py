"""Evaluation of spans against gold ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resolve import islands, overlap_join


def uncovered(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Gold spans that no predicted span overlaps."""
    return overlap_join(gold, pred, keys, "left_anti")


def covered_chars(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gold_chars, covered_chars): both sides become disjoint ranges, whose common parts are added up."""

    def ranges(d: DataFrame) -> DataFrame:
        return islands(d.select(*keys, "start", "end").where(F.col("start") < F.col("end")), keys).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))

    g, p = ranges(gold), ranges(pred).select(*keys, F.col("start").alias("ps"), F.col("end").alias("pe"))
    total = g.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("gold_chars"))
    common = g.join(p, keys).where((F.col("start") < F.col("pe")) & (F.col("ps") < F.col("end"))).groupBy(*keys).agg(F.sum(F.least("end", "pe") - F.greatest("start", "ps")).alias("covered_chars"))
    return total.join(common, keys, "left").select(*keys, "gold_chars", F.coalesce("covered_chars", F.lit(0)).alias("covered_chars"))


def rates(docs: DataFrame, gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """character_leak_rate, full_exposure_rate and clean_pollution_rate over ``docs`` (working definitions)."""
    chars = covered_chars(gold, pred, keys)
    has = pred.select(*keys).distinct().withColumn("has_pred", F.lit(True))
    all_ = docs.select(*keys).join(chars, keys, "left").join(has, keys, "left")
    gold_ = F.col("gold_chars").isNotNull()
    return all_.agg(
        (1 - F.sum("covered_chars") / F.sum("gold_chars")).alias("character_leak_rate"),
        (F.count_if(gold_ & (F.col("covered_chars") == 0)) / F.count_if(gold_)).alias("full_exposure_rate"),
        (F.count_if(~gold_ & F.col("has_pred").isNotNull()) / F.count_if(~gold_)).alias("clean_pollution_rate"),
    )


def classify(expected: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, start, end, outcome): exact, partial, wrong_kind or none for each expected span."""
    e = expected.select(*keys, "kind", "start", "end").distinct()
    p = pred.select(*keys, F.col("kind").alias("pk"), F.col("start").alias("ps"), F.col("end").alias("pe"))
    j = e.join(p, keys, "left").withColumn("over", (F.col("ps") < F.col("end")) & (F.col("start") < F.col("pe")))
    same = F.col("pk") == F.col("kind")
    level = F.when(F.col("over") & same & (F.col("ps") == F.col("start")) & (F.col("pe") == F.col("end")), 3).when(F.col("over") & same, 2).when(F.col("over"), 1).otherwise(0)
    best = j.groupBy(*keys, "kind", "start", "end").agg(F.max(level).alias("l"))
    return best.select(*keys, "kind", "start", "end", F.element_at(F.array(*map(F.lit, ("none", "wrong_kind", "partial", "exact"))), F.col("l") + 1).alias("outcome"))


def gate(deleted: DataFrame, sets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, failed): whether a set has deletions or no result."""
    return sets.join(deleted, "name", "left").groupBy(*(by or [])).agg(F.bool_or(F.col("deletions").isNull() | (F.col("deletions") > 0)).alias("failed"))


def reject_benefit(spans: DataFrame, gold: DataFrame, keys: list[str], predicate) -> DataFrame:
    """(removed_false, removed_true): what rejecting by a predicate takes away from wrong and from right spans."""
    right = overlap_join(spans, gold, keys, "left_semi").withColumn("right", F.lit(True))
    wrong = overlap_join(spans, gold, keys, "left_anti").withColumn("right", F.lit(False))
    gone = right.unionByName(wrong).where(predicate)
    return gone.agg(F.count_if(~F.col("right")).alias("removed_false"), F.count_if("right").alias("removed_true"))


def arms(rules: DataFrame, hints: DataFrame) -> DataFrame:
    """Predictions of the four arms: rules alone or with hints, conservative (no hints ever) or balanced."""
    out = None
    for model in (False, True):
        for profile in ("conservative", "balanced"):
            rows = rules.unionByName(hints) if model and profile == "balanced" else rules
            rows = rows.withColumn("arm", F.lit(f"{'rules_model' if model else 'rules'}_{profile}"))
            out = rows if out is None else out.unionByName(rows)
    return out


def skeleton(text: Column, values: Column) -> Column:
    """What is left of a text without its values, blanks and punctuation: every occurrence of each value goes, in their order."""
    bare = F.aggregate(F.filter(values, lambda v: v != ""), text, lambda acc, v: F.replace(acc, v, F.lit("")))
    return F.regexp_replace(bare, r"[^\p{L}\p{N}]+", "")


def leaks(train: DataFrame, evaluation: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, same_context, same_value) of evaluation texts that training knows.

    Both sides: text and values (array of the spans' texts); evaluation with keys. A context is known if a training text
    has the same skeleton, whatever values stood in either; one without letters or digits tells nothing. A value is known
    if a training span has it. Digests meet in joins, training ones once each. Null texts have no skeleton, null values none.
    """
    digest = lambda: F.sha2(F.nullif(skeleton(F.col("text"), F.coalesce("values", F.array().cast("array<string>"))), F.lit("")), 256)
    contexts = train.select(digest().alias("_d")).where("_d is not null").distinct().withColumn("_c", F.lit(True))
    told = train.select(F.explode(F.array_distinct("values")).alias("_v")).select(F.sha2("_v", 256).alias("_d")).where("_d is not null").distinct()
    asked = evaluation.select(*keys, F.explode(F.array_distinct("values")).alias("_v")).select(*keys, F.sha2("_v", 256).alias("_d"))
    values = asked.join(told, "_d", "left_semi").select(*keys).distinct().withColumn("_s", F.lit(True))
    found = evaluation.select(*keys, digest().alias("_d")).join(contexts, "_d", "left").groupBy(*keys).agg(F.bool_or(F.col("_c").isNotNull()).alias("same_context"))
    out = found.join(values, keys, "left").select(*keys, "same_context", F.col("_s").isNotNull().alias("same_value"))
    return out.where("same_context or same_value")
