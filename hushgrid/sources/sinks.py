"""Results to files: redacted texts, predictions, receipts."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_redacted(df: DataFrame, path: str, column: str = "outbound_text") -> None:
    """One text a line; blocked documents (null) are left out."""
    df.where(F.col(column).isNotNull()).select(column).write.text(path)


def write_predictions(df: DataFrame, path: str, arm: str = "arm") -> None:
    """JSON lines, a folder for each arm."""
    df.write.partitionBy(arm).json(path)


def receipt(parts: dict[str, DataFrame], columns: dict[str, list[str]], meta: dict) -> dict:
    """Metadata with a hash of each table's rows, whatever their order, and a hash of the whole."""
    out = dict(meta)
    for name, df in parts.items():
        row = F.xxhash64(*sorted(columns[name])).cast("decimal(38,0)")
        r = df.agg(F.count("*").alias("n"), F.sum(row).alias("s")).first()
        out[name] = {"rows": r.n, "hash": hashlib.sha256(f"{r.n}:{r.s}".encode()).hexdigest()}
    body = json.dumps(out, sort_keys=True, ensure_ascii=False)
    return out | {"self": hashlib.sha256(body.encode()).hexdigest()}
