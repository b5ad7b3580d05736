"""Values and candidates with known answers, derived from the keys of the given tables.

The candidate table is SQL that both Spark and the checking engine run, so that relational operators can be
held against plain SQL on the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import kinds
from ..functions import validators as v


def _kind(n: str) -> str:
    return f"case {n} % 24 " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(kinds.NAMES)) + " end"


def candidates_sql(orders: str = "orders") -> str:
    """doc_id, seq, kind, decision, policy, source, start_, end_, raw: five spans for each order."""
    return " union all ".join(_span_sql(str(i), orders) for i in range(5))


def _span_sql(i: str, orders: str) -> str:
    """Span ``i`` of each order: a number, or the name of a column of ``orders`` that holds it."""
    return (
        f"select o_orderkey as doc_id, cast({i} as int) as seq, {_kind(f'(o_orderkey * 7 + {i} * 5)')} as kind, "
        f"case when (o_orderkey + {i}) % 5 = 0 then 'block' else 'replace' end as decision, "
        f"case (o_orderkey + {i} * 3) % 7 when 1 then 'confirm' when 3 then 'block' when 5 then 'replace' end as policy, "
        f"case (o_orderkey + {i}) % 4 when 0 then 'structured' when 1 then 'context' when 2 then 'semantic' end as source, "
        f"cast((o_orderkey * 13 + {i} * 11) % 40 as int) as start_, cast((o_orderkey * 13 + {i} * 11) % 40 + 3 + (o_orderkey + {i}) % 9 as int) as end_, "
        f"concat('V', cast(o_custkey % 50 as varchar(20)), '-', cast({i} % 3 as varchar(20))) as raw from {orders}"
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    out = spark.sql(candidates_sql("{orders}"), orders=orders)
    return out.withColumnsRenamed({"start_": "start", "end_": "end"}).withColumn("normalized", F.col("raw"))


#: Orders, of five candidates each, in a part of ``dealt_candidates``.
PART = 50_000


def dealt_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``candidates`` for work on each document: orders are dealt by their key before their spans are made, so all that follows
    by document needs no further shuffle. Parts grow in number with the table, not in size: one that is left to its compressed
    size holds some sixty times as much once its rows are sorted."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    parts = max(spark.sparkContext.defaultParallelism, -(-orders.count() // PART))
    each = orders.repartition(parts, "o_orderkey").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4))))
    out = spark.sql(_span_sql("i", "{each}"), each=each)
    return out.withColumnsRenamed({"start_": "start", "end_": "end"}).withColumn("normalized", F.col("raw"))


def _sum(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _at(s: Column, i: int) -> Column:
    return F.substring(s, i + 1, 1).cast("int")


def china_id(k: Column, good: Column) -> Column:
    """An ID whose check character is right where ``good``, else the next one."""
    body = F.concat(F.lit("110105"), (F.lit(1950) + k % 50).cast("string"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lpad((k % 1000).cast("string"), 3, "0"))
    at = (_sum([_at(body, i) * w for i, w in enumerate(v.ID_WEIGHTS)]) + F.when(good, 0).otherwise(1)) % 11
    return F.concat(body, F.substring(F.lit(v.ID_CHECKS), at + 1, F.lit(1)))


def card(k: Column, good: Column) -> Column:
    body = F.concat(F.lit("4"), F.lpad((k * 7919 % 100000000000000).cast("string"), 14, "0"))
    doubled = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    total = _sum([doubled(_at(body, i)) if i % 2 == 0 else _at(body, i) for i in range(15)])
    return F.concat(body, ((10 - total % 10 + F.when(good, 0).otherwise(3)) % 10).cast("string"))


def uscc(k: Column, good: Column) -> Column:
    body = F.concat(F.lit("91110108MA"), F.lpad((k % 10000000).cast("string"), 7, "0"))
    place = lambda i: F.position(F.substring(body, i + 1, 1), F.lit(v.USCC_ALPHABET)) - 1
    check = (31 - _sum([place(i) * w for i, w in enumerate(v.USCC_WEIGHTS)]) % 31 + F.when(good, 0).otherwise(5)) % 31
    return F.concat(body, F.substring(F.lit(v.USCC_ALPHABET), check + 1, F.lit(1)))


def vin(k: Column, good: Column) -> Column:
    head, tail = F.lit("1HGCM826"), F.concat(F.lit("A"), F.lpad((k % 10000000).cast("string"), 7, "0"))
    digits = F.translate(F.concat(head, F.lit("0"), tail), v.VIN_LETTERS, v.VIN_VALUES)
    check = (_sum([_at(digits, i) * w for i, w in enumerate(v.VIN_WEIGHTS)]) + F.when(good, 0).otherwise(1)) % 11
    return F.concat(head, F.when(check == 10, "X").otherwise(check.cast("string")), tail)


def phone(k: Column) -> Column:
    return F.concat(F.lit("1"), (k % 7 + 3).cast("string"), F.lpad((k % 1000000000).cast("string"), 9, "0"))
