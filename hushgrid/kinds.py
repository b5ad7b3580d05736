"""The dimension of sensitive kinds and the sizes that bound the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kind, priority (lower wins), token prefix, default decision, high risk, evaluation label, surrogate label.
KINDS = (
    ("api_key", 0.0, "API_KEY", "block", True, None),
    ("access_token", 1.0, "ACCESS_TOKEN", "block", True, None),
    ("private_key", 2.0, "PRIVATE_KEY", "block", True, None),
    ("private_url", 2.5, "PRIVATE_URL", "block", True, None),
    ("connection_string", 3.0, "CONNECTION_STRING", "block", True, None),
    ("china_id", 4.0, "CHINA_ID", "replace", False, "CN_ID"),
    ("unified_social_credit_code", 5.0, "USCC", "replace", False, None),
    ("license_plate", 5.5, "LICENSE_PLATE", "replace", False, "LICENSE_PLATE"),
    ("labeled_identifier", 6.0, "IDENTIFIER", "replace", False, None),
    ("mac_address", 6.6, "MAC_ADDRESS", "replace", False, None),
    ("bank_card", 7.0, "BANK_CARD", "replace", False, "BANK_CARD"),
    ("bank_account", 7.2, "BANK_ACCOUNT", "replace", False, None),
    ("passport", 7.5, "PASSPORT", "replace", False, "PASSPORT"),
    ("person_name", 8.0, "PERSON", "replace", False, "PERSON"),
    ("private_date", 8.5, "PRIVATE_DATE", "replace", False, None),
    ("address", 9.0, "ADDRESS", "replace", False, "ADDRESS"),
    ("account", 10.0, "ACCOUNT", "replace", False, "ACCOUNT_ALIAS"),
    ("credential", 11.0, "CREDENTIAL", "block", True, None),
    ("phone", 12.0, "PHONE", "replace", False, "CN_PHONE"),
    ("email", 13.0, "EMAIL", "replace", False, "EMAIL"),
    ("local_path", 14.0, "LOCAL_PATH", "replace", False, None),
    ("ipv4", 15.0, "IPV4", "replace", False, None),
    ("ipv6", 15.5, "IPV6", "replace", False, None),
    ("custom_term", 16.0, "CUSTOM", "replace", False, None),
)
MAX_TOKENS, MAX_TERMS, MAX_TERM_LENGTH, MAX_AUDIT = 10_000, 100, 120, 100
MAX_CREDENTIAL, MAX_LABELED, MAX_OCR_WORDS, MAX_OCR_TEXT, MAX_RECTANGLES = 4096, 120, 10_000, 512, 2048
NAMES = tuple(k[0] for k in KINDS)


def kind_table(spark: SparkSession) -> DataFrame:
    """(kind, priority, prefix, decision, high_risk, eval_label)."""
    return spark.createDataFrame(list(KINDS), "kind string, priority double, prefix string, decision string, high_risk boolean, eval_label string")


def lookup(kind: Column, field: int) -> Column:
    """A field of the dimension as an expression."""
    out = F.lit(None)
    for k in KINDS:
        if k[field] is not None:
            out = F.when(kind == k[0], F.lit(k[field])).otherwise(out)
    return out


def priority(kind: Column) -> Column:
    return lookup(kind, 1)


def prefix(kind: Column) -> Column:
    return lookup(kind, 2)


def high_risk(kind: Column) -> Column:
    return kind.isin(*[k[0] for k in KINDS if k[4]])
