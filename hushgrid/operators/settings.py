"""Settings: terms, batches of lines, defaults, presets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import kinds
from .resolve import merge_allowlists

ENTRY = T.StructType([T.StructField("value", T.StringType()), T.StructField("siteId", T.StringType()), T.StructField("expiresAt", T.StringType())])
POLICY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("action", T.StringType())])
SCHEMA = T.StructType([
    T.StructField("settingsVersion", T.IntegerType()), T.StructField("mode", T.StringType()), T.StructField("allowlistedTerms", T.ArrayType(T.StringType())),
    T.StructField("siteAllowlist", T.ArrayType(ENTRY)), T.StructField("categoryPolicies", T.ArrayType(POLICY)), T.StructField("detectionProfile", T.StringType()),
    T.StructField("replacementStyle", T.StringType()), T.StructField("replyTokenViewerEnabled", T.BooleanType()), T.StructField("attachmentAction", T.StringType()), T.StructField("semanticReview", T.StringType()),
])
# Defaults of a settings object.
DEFAULTS = {"detectionProfile": "balanced", "replacementStyle": "token", "attachmentAction": "warn", "semanticReview": "local_neural"}


def parse(df: DataFrame, json: str) -> DataFrame:
    """``df`` with settings: parsed, with defaults; the token viewer only goes with the token style."""
    s = F.from_json(json, SCHEMA)
    out = df.withColumn("settings", s)
    for k, d in DEFAULTS.items():
        out = out.withColumn("settings", F.col("settings").withField(k, F.coalesce(F.col("settings")[k], F.lit(d))))
    viewer = F.coalesce(F.col("settings.replyTokenViewerEnabled"), F.lit(False)) & (F.col("settings.replacementStyle") == "token")
    return out.withColumn("settings", F.col("settings").withField("replyTokenViewerEnabled", viewer))


def valid_terms(terms: DataFrame, by: list[str], term: str) -> DataFrame:
    """(by, n, valid): at most MAX_TERMS terms of 1 to MAX_TERM_LENGTH characters, all different, once trimmed."""
    t = F.trim(term)
    ok = (F.count("*") <= kinds.MAX_TERMS) & (F.min(F.length(t)) >= 1) & (F.max(F.length(t)) <= kinds.MAX_TERM_LENGTH) & (F.count("*") == F.count_distinct(t))
    return terms.groupBy(*by).agg(F.count("*").alias("n"), ok.alias("valid"))


def batch_lines(df: DataFrame, keys: list[str], text: str, limit: int = kinds.MAX_TERMS, longest: int = kinds.MAX_TERM_LENGTH) -> DataFrame:
    """(keys, added, error, error_line) of pasted lines: blank ones skipped, the first error by line number."""
    lines = df.select(*keys, F.posexplode(F.split(text, "\n")).alias("line", "raw")).select(*keys, (F.col("line") + 1).alias("line"), F.trim("raw").alias("t")).where("t != ''")
    w = Window.partitionBy(*keys).orderBy("line")
    again = F.row_number().over(Window.partitionBy(*keys, "t").orderBy("line")) > 1
    told = lines.withColumn("again", again).withColumn("n", F.row_number().over(w))
    error = F.when(F.length("t") > longest, "too_long").when(F.col("again"), "duplicate").when(F.col("n") > limit, "limit")
    out = told.withColumn("e", error).groupBy(*keys).agg(F.min(F.when(F.col("e").isNotNull(), F.struct("line", "e"))).alias("first"), F.count("*").alias("n"))
    return out.select(*keys, F.when(F.col("first").isNull(), F.col("n")).otherwise(0).alias("added"), F.col("first.e").alias("error"), F.col("first.line").alias("error_line"))


# What the fields of a settings object may be.
MODES, PROFILES, STYLES = ("replace", "block"), ("conservative", "balanced"), ("token", "masked", "surrogate")
ATTACHMENT_ACTIONS, REVIEWS, ACTIONS = ("allow", "warn", "confirm", "block"), ("off", "local_statistical", "local_neural", "local_provider"), ("replace", "confirm", "block")


def _terms_valid(terms: Column) -> Column:
    """At most MAX_TERMS of 1 to MAX_TERM_LENGTH characters, all different, once trimmed."""
    t = F.transform(terms, lambda x: F.trim(x))
    return F.coalesce((F.size(t) <= kinds.MAX_TERMS) & F.forall(t, lambda x: F.length(x).between(1, kinds.MAX_TERM_LENGTH)) & (F.size(F.array_distinct(t)) == F.size(t)), F.lit(False))


def validity(json: Column) -> Column:
    """Whether a settings object is valid: fields that are there have a value of their kind; any other makes it invalid.

    A bare list of terms is the old form. Nulls and what isn't JSON are invalid.
    """
    field = lambda k: F.get_json_object(json, f"$.{k}")
    absent = lambda k: field(k).isNull()
    listed = lambda k, kind: F.from_json(field(k), kind)
    old = F.trim(json).startswith("[")
    terms = listed("terms", "array<string>")
    sites = F.from_json(field("siteAllowlist"), T.ArrayType(ENTRY))
    policies = F.from_json(field("categoryPolicies"), T.ArrayType(POLICY))
    site_ok = (F.size(sites) <= kinds.MAX_TERMS) & F.forall(sites, lambda x: F.length(F.trim(x["value"])).between(1, kinds.MAX_TERM_LENGTH) & x["siteId"].isNotNull() & (x["expiresAt"].isNull() | x["expiresAt"].try_cast("timestamp").isNotNull()))
    site_ok &= F.size(F.array_distinct(F.transform(sites, lambda x: F.struct(x["siteId"], F.trim(x["value"]))))) == F.size(sites)
    policy_ok = F.forall(policies, lambda x: x["kind"].isin(*kinds.NAMES) & x["action"].isin(*ACTIONS)) & (F.size(F.array_distinct(F.transform(policies, lambda x: x["kind"]))) == F.size(policies))
    ok = F.coalesce(field("mode").isin(*MODES), F.lit(False)) & _terms_valid(terms)
    ok &= absent("allowlistedTerms") | _terms_valid(listed("allowlistedTerms", "array<string>"))
    ok &= absent("siteAllowlist") | F.coalesce(site_ok, F.lit(False))
    ok &= absent("categoryPolicies") | F.coalesce(policy_ok, F.lit(False))
    for k, allowed in (("detectionProfile", PROFILES), ("replacementStyle", STYLES), ("attachmentAction", ATTACHMENT_ACTIONS), ("semanticReview", REVIEWS), ("auditEnabled", ("true", "false")), ("replyTokenViewerEnabled", ("true", "false"))):
        ok &= absent(k) | field(k).isin(*allowed)
    return F.coalesce(F.when(old, _terms_valid(F.from_json(json, "array<string>"))).otherwise(ok), F.lit(False))


def imported(df: DataFrame, envelope: str) -> DataFrame:
    """``df`` with error (invalid_json, invalid_configuration, unsupported_schema or null) and settings (JSON) of an exported envelope."""
    e = F.col(envelope)
    version, inner = F.get_json_object(e, "$.schemaVersion"), F.get_json_object(e, "$.settings")
    keys = F.array_sort(F.json_object_keys(e))
    error = (
        F.when(F.try_parse_json(e).isNull(), "invalid_json").when(~keys.eqNullSafe(F.array(F.lit("schemaVersion"), F.lit("settings"))), "invalid_configuration")
        .when(version.eqNullSafe(F.lit("1")), F.when(validity(inner), F.lit(None)).otherwise("invalid_configuration")).when(version.try_cast("double").isNotNull(), "unsupported_schema").otherwise("invalid_configuration")
    )
    return df.withColumn("error", error).withColumn("settings", F.when(F.col("error").isNull(), inner))


def import_allowlists(current: DataFrame, incoming: DataFrame, mode: str = "replace") -> DataFrame:
    """(value, site_id, expires_at) after an import: the incoming ones, or both merged."""
    if mode not in ("replace", "merge"):
        raise ValueError(f"import mode {mode}")
    return incoming.select("value", "site_id", "expires_at") if mode == "replace" else merge_allowlists(current, incoming)


def term_union(first: Column, second: Column) -> Column:
    """Distinct trimmed terms of both lists in the order of their first appearance."""
    return F.array_distinct(F.filter(F.transform(F.concat(first, second), lambda x: F.trim(x)), lambda x: x != ""))


def without_term(terms: Column, gone: Column) -> Column:
    """Terms but those that equal ``gone`` once trimmed."""
    return F.filter(terms, lambda x: F.trim(x) != F.trim(gone))


def preset_policies(spark: SparkSession, pack: dict) -> DataFrame:
    """(kind, action) of a preset pack."""
    return spark.createDataFrame([(p["kind"], p["action"]) for p in pack["categoryPolicies"]], "kind string, action string")


def export(df: DataFrame, settings: str) -> DataFrame:
    """``df`` with envelope: the settings as JSON under schema version 1."""
    return df.withColumn("envelope", F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.col(settings).alias("settings"))))
