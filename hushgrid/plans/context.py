"""Registered queries of addresses, accounts, names and hints in context: sentences made from customer keys, with their spans in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hints, resolve, spans
from .catalog import register, spread, t
from .gates import K, _filled, _filled_sql

#: Text before, value, text after, and whether the value is found; {k} is the key, {e} its last eight digits in full width.
_ADDRESSES = (
    ("资料寄到", "北京市海淀区中关村软件园二期{k}号楼1201", "。", True),
    ("", "上海市浦东新区世纪大道{k}号", "附近开了新店。", True),
    ("改为", "上海市浦东新区世纪大道 {k} 号", "", True),
    ("见面 ", "浙江杭州西湖文三路 {k} 号", "的民宿 5月20日入住", True),
    ("在您小区 ", "朝阳门外大街 {k} 号", " 8 点见", True),
    ("", "朝阳望京街 {k} 号望京 SOHO T1 B 座 1701", " 130", True),
    ("請寄到", "臺北市信義區松仁路{k}號12樓", "。", True),
    ("到市场部会议室", "{k}楼", "开会", False),
    ("顺路去超市", "{k}", "楼", False),
    ("`上海市浦东新区世纪大道", "{k}", "号`", False),
)
_ACCOUNTS = (
    ("先搜 ", "demo_user{k}", " 再说", True),
    ("备用账号是 ", "wx_lin{k}", "。", True),
    ("会话入口改成 ", "小林_0{k}", "", True),
    ("对接窗口切到 ", "lin.moyan{k}", "", True),
    ("页面显示 ", "lin_{k}", "，就这样", True),
    ("请在群里加 ", "@moyan_zhang{k}", " 聊", True),
    ("账号：", "lin{k}x", "，就这样", True),
    ("这不是账号，订单 ", "demo_user{k}", "", False),
    ("变量名 handle 是 ", "sample_user{k}", " 测试", False),
    ("`先搜 ", "demo_user{k}", "`", False),
)
_NAMES = (
    ("", "郭静", "13800138000 {k}", True),
    ("{k} 13800138000，是", "沈砚", "", True),
    ("{k} 微信加", "沈砚", " a_b@c.io", True),
    ("", "沈砚", "的手机号 13800138000，{k}", True),
    ("{k} ", "方案", "13800138000", False),
    ("{k} ", "李白", " 13800138000 历史展", False),
)


def _spans_sql(variants: tuple) -> str:
    one = lambda i, a, x: f"select c_custkey as doc_id, length({_filled_sql(a)})::int as start_at, (length({_filled_sql(a)}) + length({_filled_sql(x)}))::int as end_at, {_filled_sql(x)} as raw from customer where c_custkey % {len(variants)} = {i}"
    return " union all ".join(one(i, a, x) for i, (a, x, _, found) in enumerate(variants) if found)


def _sentences(spark, sf_dir, variants: tuple):
    text = F.lit(None).cast("string")
    for i, (a, x, b, _) in enumerate(variants):
        text = F.when(K() % len(variants) == i, F.concat(_filled(a, K()), _filled(x, K()), _filled(b, K()))).otherwise(text)
    return spread(t(spark, sf_dir, "customer").select("c_custkey")).select(K().alias("doc_id"), text.alias("text"))


def _found(spark, sf_dir, variants: tuple, kind: str):
    s = resolve.select_spans(spans.detect(_sentences(spark, sf_dir, variants), ["doc_id"], "text"), ["doc_id"])
    return s.where(F.col("kind") == kind).select("doc_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "raw")


@register("address_spans", _spans_sql(_ADDRESSES))
def address_spans(spark, sf_dir):
    """Addresses by their structure and after anchors; right edges and near misses; all rules at once."""
    return _found(spark, sf_dir, _ADDRESSES, "address")


@register("account_spans", _spans_sql(_ACCOUNTS))
def account_spans(spark, sf_dir):
    """Accounts by phrases, cues and labels, and near misses."""
    return _found(spark, sf_dir, _ACCOUNTS, "account")


@register("names_beside_values", _spans_sql(_NAMES))
def names_beside_values(spark, sf_dir):
    """Names next to numbers and mail addresses, on either side."""
    return _found(spark, sf_dir, _NAMES, "person_name")


#: Text before, the hint's text, text after, its kind, and the kind of the candidate (None: none).
_HINTED = (
    ("电话 {k}，", "幺三八零零幺三八零零零", " 拨打", "phone", "phone"),
    ("请加 ", "lin_{k}", " 聊", "phone", "account"),
    ("写信 ", "demo_user{k} at example dot invalid", " 吧", "email", "email"),
    ("实名 ", "110105194912310020", " {k}", "china_id", "china_id"),
    ("号 ", "110105194912310020", " {k}", "china_id", None),
    ("付款 ", "6200000000000000", " {k}", "bank_card", "bank_card"),
    ("数 ", "6200000000000001", " {k}", "bank_card", None),
    ("车 ", "京a12345", " {k}", "license_plate", "license_plate"),
    ("护照 ", "ab1234567", " {k}", "passport", "passport"),
    ("生日 ", "1990-02-11", " {k}", "private_date", "private_date"),
    ("日期 ", "1990-02-11", " {k}", "private_date", None),
    ("对公账户 ", "6222021234567890", " {k}", "bank_account", "bank_account"),
    ("口令 ", "abc{k}def", " 记住", "credential", "credential"),
    ("云服务密钥 ", "live-key-{k}", " 记住", "api_key", "api_key"),
    ("请求头 ", "tok-abc-{k}", " 记住", "access_token", "access_token"),
    ("员工 ", "A-{k}", " 在", "labeled_identifier", "labeled_identifier"),
    ("主机 ", "10.0.0.300", " {k}", "ipv4", None),
    ("变量名 ", "幺三八零零幺三八零零零", " 拨打 {k}", "phone", None),
    ("`电话 ", "幺三八零零幺三八零零零", " 拨打` {k}", "phone", None),
    ("由 ", " 沈砚 ", "负责 {k}", "person_name", "person_name"),
)


def _hinted_sql() -> str:
    rows = []
    for i, (a, x, _, _, kind) in enumerate(_HINTED):
        if kind:
            lead, core = len(x) - len(x.lstrip()), x.strip()
            at = f"length({_filled_sql(a)}) + {lead}"
            rows.append(f"select c_custkey as doc_id, '{kind}' as kind, ({at})::int as start_at, ({at} + length({_filled_sql(core)}))::int as end_at, {_filled_sql(core)} as raw from customer where c_custkey % {len(_HINTED)} = {i}")
    return " union all ".join(rows)


def _hints(spark, sf_dir):
    """The sentences, and a hint over each one's value."""
    texts = _sentences(spark, sf_dir, tuple(v[:4] for v in _HINTED))
    n = F.col("doc_id") % len(_HINTED)
    start = end = kind = F.lit(None)
    for i, (a, x, _, k, _) in enumerate(_HINTED):
        at = F.length(_filled(a, F.col("doc_id")))
        start, end = F.when(n == i, at).otherwise(start), F.when(n == i, at + F.length(_filled(x, F.col("doc_id")))).otherwise(end)
        kind = F.when(n == i, k).otherwise(kind)
    return texts, texts.select("doc_id", kind.alias("kind"), start.cast("int").alias("start"), end.cast("int").alias("end"))


@register("hint_gates", _hinted_sql())
def hint_gates(spark, sf_dir):
    """Hints of each kind that pass their gate, one that becomes an account, and ones that fail."""
    texts, given = _hints(spark, sf_dir)
    out = hints.as_candidates(given, texts, ["doc_id"], "text", 2026)
    return out.select("doc_id", "kind", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "raw")


@register("hint_candidates", """
    select c_custkey as doc_id, kind, source from customer, (values
      (0, 'china_id', 'semantic'), (1, 'email', null), (2, 'email', 'semantic'), (3, 'account', 'context'), (3, 'person_name', 'semantic'), (4, 'phone', 'semantic')) as v(n, kind, source)
    where c_custkey % 5 = n""")
def hint_candidates(spark, sf_dir):
    """What gives way: a phone inside a valid ID, a hint over a finding that is sure, an account guessed under a typed hint; a name over an account stays beside it."""
    k = F.col("c_custkey")
    #   n, hint's kind, valid_id, candidate's kind and source
    cases = ((0, "china_id", True, "phone", "structured"), (1, "phone", False, "email", None), (2, "email", False, "account", "context"), (3, "person_name", False, "account", "context"), (4, "phone", False, "phone", "outside"))
    base = t(spark, sf_dir, "customer").select(k.alias("doc_id"))
    span = [F.lit("replace").alias("decision"), F.lit("confirm").alias("policy"), F.lit(10).alias("start"), F.lit(20).alias("end"), F.lit("v").alias("raw"), F.lit("v").alias("normalized")]
    pick = lambda j, sql: F.coalesce(*[F.when(F.col("doc_id") % 5 == c[0], F.lit(c[j]).cast(sql)) for c in cases])
    found = base.where("doc_id % 5 != 4").select("doc_id", pick(3, "string").alias("kind"), pick(4, "string").alias("source"), *span)
    hinted = base.select("doc_id", pick(1, "string").alias("kind"), F.lit("semantic").alias("source"), *span, pick(2, "boolean").alias("valid_id"))
    return hints.with_hints(found, hinted, ["doc_id"]).select("doc_id", "kind", "source")
