"""Tokens, rewriting and decisions for documents and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import kinds
from ..functions import text as tx


def number_tokens(spans: DataFrame, session: list[str], order: list[str]) -> DataFrame:
    """(session, kind, normalized, raw, n, token): values numbered by first appearance in their session and kind.

    The first raw spelling stands for a value. Over MAX_TOKENS values of a session raise an error.
    """
    first = spans.groupBy(*session, "kind", "normalized").agg(F.min(F.struct(*order)).alias("at"), F.min_by("raw", F.struct(*order)).alias("raw"))
    n = F.row_number().over(Window.partitionBy(*session, "kind").orderBy("at", "normalized"))
    total = F.count("*").over(Window.partitionBy(*session)) if session else F.lit(0)
    out = first.withColumn("n", n).withColumn("total", total)
    safe = F.when(F.col("total") > kinds.MAX_TOKENS, F.raise_error(F.lit("session token capacity exceeded")).cast("int")).otherwise(F.col("n"))
    return out.withColumn("n", safe).select(*session, "kind", "normalized", "raw", "n", tx.token(F.col("kind"), F.col("n")).alias("token"))


def replacement(style: str, kind: Column, raw: Column, n: Column) -> Column:
    return {"token": tx.token(kind, n), "masked": tx.mask(kind, raw), "surrogate": tx.surrogate(kind, n)}[style]


def rewrite(docs: DataFrame, spans: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``docs`` with redacted_text: gaps and replacements in the order of their starts. spans: keys, start, end, replacement."""
    by = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("sp"))
    joined = docs.join(by, keys, "left")
    t = F.col(text)
    parts = F.transform("sp", lambda x, i: F.concat(F.substring(t, F.when(i == 0, 0).otherwise(F.get("sp", i - 1)["end"]) + 1, x["start"] - F.when(i == 0, 0).otherwise(F.get("sp", i - 1)["end"])), x["replacement"]))
    rest = F.substring(t, F.element_at("sp", -1)["end"] + 1, F.length(t))
    return joined.withColumn("redacted_text", F.when(F.col("sp").isNull(), t).otherwise(F.concat(F.array_join(parts, ""), rest))).drop("sp")


def detokenize(docs: DataFrame, tokens: DataFrame, keys: list[str], session: list[str], text: str = "text") -> DataFrame:
    """(keys, token, raw): tokens in a text that its own session knows."""
    seen = docs.select(*dict.fromkeys([*keys, *session]), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[\[[A-Z0-9_]+\]\]"), F.lit(0)))).alias("token"))
    return seen.join(tokens.select(*session, "token", "raw"), [*session, "token"]).select(*keys, "token", "raw")


def action(selected: DataFrame, keys: list[str], strict: bool = False, **more: Column) -> DataFrame:
    """block, confirm or replace for every document with selected spans; those without are native. ``more``: other aggregates of the same pass, by name."""
    block = F.bool_or(F.coalesce(F.col("policy") == "block", F.lit(False)))
    ask = F.bool_or(F.coalesce(F.col("policy") == "confirm", F.lit(False)) | (F.col("decision") == "block")) | F.lit(strict)
    return selected.groupBy(*keys).agg(F.when(block, "block").when(ask, "confirm").otherwise("replace").alias("action"), *[c.alias(n) for n, c in more.items()])


def redact(docs: DataFrame, selected: DataFrame, keys: list[str], session: list[str], text: str = "text", style: str = "token") -> DataFrame:
    """``docs`` with redacted_text, status and outbound_text (null where a selected span blocks)."""
    order = [*[k for k in keys if k not in session], "start"]
    tokens = number_tokens(selected, session, order)
    named = selected.join(tokens.select(*session, "kind", "normalized", "n"), [*session, "kind", "normalized"])
    spans = named.select(*keys, "start", "end", replacement(style, F.col("kind"), F.col("raw"), F.col("n")).alias("replacement"))
    blocked = selected.where("decision = 'block'").select(*keys).distinct().withColumn("blocked", F.lit(True))
    out = rewrite(docs, spans, keys, text).join(blocked, keys, "left")
    return out.withColumn("status", F.when(F.col("blocked"), "blocked").otherwise("ready")).withColumn("outbound_text", F.when(F.col("blocked").isNull(), F.col("redacted_text"))).drop("blocked")


def attachment_action(setting: Column, scoped: Column) -> Column:
    """What to do with an attachment: the setting, and where the page can't be inspected the next stricter one."""
    return F.when(setting == "block", "block").when(setting == "confirm", "confirm").when(setting == "warn", F.when(scoped, "warn").otherwise("confirm")).otherwise(F.when(scoped, "allow").otherwise("warn"))


def reply_state(docs: DataFrame, tokens: DataFrame, keys: list[str], session: list[str], text: str = "text") -> DataFrame:
    """(keys, tokens, known, state): distinct tokens in a reply, those its session knows, and what follows."""
    seen = docs.select(*keys, F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[\[[A-Z0-9_]+\]\]"), F.lit(0)))).alias("tokens"))
    known = detokenize(docs, tokens, keys, session, text).groupBy(*keys).agg(F.count("*").alias("known"))
    out = seen.join(known, keys, "left").withColumn("known", F.coalesce("known", F.lit(0)))
    return out.withColumn("state", F.when(F.col("tokens") == 0, "no_tokens").when(F.col("known") == 0, "unknown_tokens").when(F.col("known") < F.col("tokens"), "partly_known").otherwise("known"))


def confirm_outcome(choice: Column) -> Column:
    """The audit outcome of a confirmation: what was sent, or that nothing was."""
    return F.when(choice.isin("redact", "session"), F.when(choice == "redact", "redacted").otherwise("allowed_session")).when(choice == "raw_once", "sent_raw").otherwise("cancelled")
