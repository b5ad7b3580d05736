"""Hints of a model as candidates: a gate for each kind, and what gives way to what.

A hint is a kind and a span; it becomes a candidate that asks for confirmation. Each kind has a shape and, mostly, words that must
stand around the span. A phone that is none may be an account. A valid ID takes the phones inside it away; a hint that
overlaps a finding which neither context nor a model inferred goes; a typed hint that stays takes the accounts that context
guessed under it away. Overlaps are looked for within islands of spans that chain together, so a long text costs no more than its islands.

A null text, a span out of bounds or of blanks alone and unknown kinds give no candidate. Repeated hints give one each.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import kinds
from ..functions import patterns as p
from ..functions import text as tx
from ..functions import unicode
from ..functions import validators as v
from .resolve import islands

# Words around the values of a kind.
AROUND = {
    "china_id": "身份证 证件 身份信息 实名 认证信息".split(),
    "bank_card": "银行卡 信用卡 卡号 收款 转账 付款 支付 打款 汇款 转入 扣款 充值 card".split(),
    "passport": "护照 旅行证 旅行證 通行证 通行證 证件 證件 访客卡 訪客卡 门禁 門禁".split(),
    "private_date": ["出生", "生日", "入职", "结婚", "纪念日", "个人日期", r"date\s*of\s*birth", r"\bdob\b"],
    "bank_account": "银行账户 银行账号 对公账户 对公账号 收款账户 收款账号 结算账户 结算账号 开户账号 银行卡账户 收款信息 打款账户".split(),
    "credential": ["凭据", "口令", "密码", "密钥", "登录信息", "鉴权信息", "secret", "credential", "pass", r"private\s*key"],
    "api_key": [r"api\s*密钥", r"api[\s_-]*key", "应用密钥", "云服务密钥", "client[_ -]?secret"],
    "access_token": "令牌 token bearer authorization 请求头 鉴权".split(),
    "labeled_identifier": "OA 员工 工号 人事 薪资 医疗 病历 医保 车架 VIN 发动机 社保 公积金 合同 归档".split(),
    "network": "服务器 主机 内网 公网 网卡 以太网 物理地址 IP MAC".split(),
}
PASSPORT, TRAVEL = r"^(?:E[A-L]?\d{7,8}|G\d{8}|[DSP]E?\d{7,8})$", r"^[A-Z]{1,2}\d{7,8}$"
KEY = r"^[A-Za-z0-9][A-Za-z0-9._~+/=-]{7,}$"
KEY_STARTS = r"(?i)^(?:sk-|sk_live_|key_live_|AIza|AKIA|gh[pousr]_)"
#: Kinds whose hints need no shape: the text decides alone.
FREE = ("person_name", "address")
NEVER_TYPED = (*FREE, "account")


def gates(raw: Column, around: Column, before: Column, technical: Column, as_of_year: int | Column) -> dict[str, Column]:
    """For each kind with a shape, whether ``raw`` is one there. around: 32 places on both sides; before: the 40 before it."""
    says = lambda kind: around.rlike(f"(?i)(?:{'|'.join(AROUND[kind])})")
    number = tx.spoken_number(F.regexp_replace(raw, r"[\s()（）·・-]", ""))
    upper = F.upper(F.regexp_replace(raw, r"[\s·・-]", ""))
    tight = F.regexp_replace(raw, r"\s+", "")
    size = F.length(raw)
    shapes = {
        "phone": number.rlike(r"^1[3-9]\d{9}$"),
        "email": tx.obfuscated_email(raw).rlike(r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]{3,}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++$"),
        "china_id": v.china_id(number) | says("china_id") & v.plausible_id(number, as_of_year),
        "bank_card": number.rlike(r"^\d{13,19}$") & ~before.rlike(p.IDENTITY_BEFORE) & (v.luhn(number) | ~v.not_a_card_context(around) & says("bank_card") & number.rlike(r"^62\d{14,17}$")),
        "license_plate": upper.rlike(rf"^[{p.PLATES}][A-Z][A-Z0-9]{{5,6}}$"),
        "passport": upper.rlike(PASSPORT) | says("passport") & upper.rlike(TRAVEL),
        "private_date": v.private_date(raw, as_of_year) & says("private_date"),
        "bank_account": v.bank_account(raw) & says("bank_account"),
        "credential": size.between(6, kinds.MAX_CREDENTIAL) & raw.rlike(r"[A-Za-z0-9\x{4e00}-\x{9fff}]") & says("credential"),
        "api_key": size.between(8, 512) & raw.rlike(KEY) & (says("api_key") | raw.rlike(KEY_STARTS)),
        "access_token": size.between(8, 4096) & raw.rlike(KEY) & says("access_token"),
        "labeled_identifier": size.between(2, 120) & says("labeled_identifier"),
        "ipv4": v.ipv4(tight) & says("network"),
        "mac_address": v.mac(tight) & says("network"),
    }
    return {k: F.coalesce(c, F.lit(False)) & ~technical for k, c in shapes.items()}


def as_candidates(hints: DataFrame, texts: DataFrame, keys: list[str], text: str, as_of_year: int | Column | None = None) -> DataFrame:
    """``hints`` (keys, kind, start, end) that pass their gates, in the columns of candidates, trimmed; ``valid_id`` marks IDs whose check character is right."""
    year = v.this_year() if as_of_year is None else as_of_year
    seen = texts.select(*keys, F.col(text).alias("_t"), unicode.view_and_code(F.when(F.col(text).contains("`") | F.col(text).contains("~~~"), F.col(text)), F.lit(True)).alias("_v"))
    whole = F.col("_t")
    rows = hints.join(seen, keys).where((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length(whole)))
    rows = rows.where(~F.coalesce(F.exists("_v.code", lambda c: (c["start"] < F.col("end")) & (F.col("start") < c["end"])), F.lit(False)))
    part = lambda lo, hi: F.substring(whole, F.greatest(lo, F.lit(0)) + 1, hi - F.greatest(lo, F.lit(0)))
    s, e = F.col("start"), F.col("end")
    rows = rows.select(
        "*", part(s, e).alias("_whole"), part(s - 32, s).alias("_ahead"), part(e, e + 32).alias("_behind"), part(s - 40, s).alias("_before"), part(s - 12, s).alias("_close"), part(s - 32, e + 32).alias("_near"),
    ).withColumn("_raw", F.trim(F.regexp_replace("_whole", r"^\s+|\s+$", "")))
    tests = gates(F.col("_raw"), F.concat_ws(" ", "_ahead", "_behind"), F.col("_before"), v.technical_context(F.col("_ahead"), F.col("_behind")), year)
    kind, account = F.col("kind"), v.account_in_context(F.col("_raw"), F.col("_close"), F.col("_near"))
    shaped = reduce(or_, [(kind == k) & c for k, c in tests.items()])
    taken = F.when(shaped | kind.isin(*FREE), kind).when(kind.isin("account", "phone") & account, "account")
    lead = F.length("_whole") - F.length(F.regexp_replace("_whole", r"^\s+", ""))
    number = tx.spoken_number(F.regexp_replace("_raw", r"[\s()（）·・-]", ""))
    named = rows.select("*", taken.alias("_kind")).where("_kind is not null and _raw != ''")
    return named.select(
        *keys, F.col("_kind").alias("kind"), F.lit("replace").alias("decision"), F.lit("confirm").alias("policy"), F.lit("semantic").alias("source"), (s + lead).alias("start"), (s + lead + F.length("_raw")).alias("end"),
        F.col("_raw").alias("raw"), tx.canonical(F.col("_kind"), F.col("_raw")).alias("normalized"), ((kind == "china_id") & v.china_id(number)).alias("valid_id"),
    )


def with_hints(cands: DataFrame, hinted: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates and those of hints (``as_candidates``) after suppression: keys, kind, decision, policy, source, start, end, raw, normalized.

    IDs act before the other hints, in whatever order these come.
    """
    fields = ["kind", "decision", "policy", "source", "start", "end", "raw", "normalized"]
    both = cands.select(*keys, *fields, F.lit(False).alias("valid_id"), F.lit(False).alias("hint")).unionByName(hinted.select(*keys, *fields, "valid_id", F.lit(True).alias("hint")))
    packed = islands(both, keys).groupBy(*keys, "island").agg(F.collect_list(F.struct(*fields, "valid_id", "hint")).alias("xs"))
    overlaps = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    packed = packed.withColumn("ids", F.filter("xs", lambda x: x["hint"] & x["valid_id"]))
    inside = lambda x: F.exists("ids", lambda i: (i["start"] <= x["start"]) & (x["end"] <= i["end"]))
    phone = lambda x: ~x["hint"] & (x["kind"] == "phone") & F.coalesce(x["source"] == "structured", F.lit(False))
    packed = packed.withColumn("xs", F.filter("xs", lambda x: ~(phone(x) & inside(x))))
    packed = packed.withColumn("sure", F.filter("xs", lambda x: ~x["hint"] & ~F.coalesce(x["source"], F.lit("")).isin("context", "semantic")))
    packed = packed.withColumn("xs", F.filter("xs", lambda x: ~(x["hint"] & F.exists("sure", lambda c: overlaps(c, x)))))
    packed = packed.withColumn("typed", F.filter("xs", lambda x: x["hint"] & ~x["kind"].isin(*NEVER_TYPED)))
    guess = lambda x: ~x["hint"] & (x["kind"] == "account") & F.coalesce(x["source"] == "context", F.lit(False))
    packed = packed.withColumn("xs", F.filter("xs", lambda x: ~(guess(x) & F.exists("typed", lambda h: overlaps(h, x)))))
    return packed.select(*keys, F.explode("xs").alias("x")).select(*keys, *[f"x.{c}" for c in fields])
