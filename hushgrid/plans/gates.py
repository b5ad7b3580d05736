"""Registered queries of gates, labelled spans, settings, reviews, OCR texts and reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import kinds
from ..functions import text as tx
from ..functions import unicode
from ..functions import validators as v
from ..functions.patterns import RULES
from ..operators import evaluate, findings, neural, ocr, resolve, semantic, settings, spans
from ..sources import sinks
from ..sources.scratch import scratch
from ..streaming.detect import detect_stream
from . import synthetic as syn
from .catalog import TOLD, C, register, spread, t
from .found import found_sql

def K() -> Column:  # noqa: N802
    return F.col("c_custkey")


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _case(values: list[str], n: str) -> str:
    return f"case {n} % {len(values)} " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(values)) + " end"


# spans of labelled values, with offsets, decisions and near misses

_VARIANTS = (
    # text before, value, text after, kind (None: nothing is found), decision, policy
    ("备注 password=", "p{k}, x", "。后面", "credential", "block", None),
    ("备注 password=\"", "q {k}", "\" 后面", "credential", "block", None),
    ("备注 passwordless=", "p{k}", "。", None, None, None),
    ("生日：", "1990-02-1{d}", "。", "private_date", "replace", None),
    ("生日：", "1990-13-1{d}", "。", None, None, None),
    ("联系人：", "张伟明", "，{k}", "person_name", "replace", None),
    ("联系人：", "付款单", "，{k}", None, None, None),
    ("合同编号：", "HT-{k}", "，完", "labeled_identifier", "replace", None),
    ("```\n我叫", "李建国", "，{k}\n```", None, None, None),
    ("{k} 我叫", "李建国", "，你好", "person_name", "replace", "confirm"),
    ("见 https://pan.baidu.com/s/", "abcdefgh{k}", ". 后面", "private_url", "block", None),
    ("电话 １３８", "{e}", " 完", "phone", "replace", None),
)


def _filled(s: str, k: Column) -> Column:
    parts: list[Column] = []
    for piece in s.replace("{", "\0{").replace("}", "}\0").split("\0"):
        parts.append({"{k}": k.cast("string"), "{d}": (k % 10).cast("string"), "{e}": F.translate(F.lpad((k % 100000000).cast("string"), 8, "0"), "0123456789", "０１２３４５６７８９")}.get(piece, F.lit(piece)))
    return F.concat(*parts)


def _filled_sql(s: str) -> str:
    parts = []
    for piece in s.replace("{", "\0{").replace("}", "}\0").split("\0"):
        wide = "translate(lpad((c_custkey % 100000000)::varchar, 8, '0'), '0123456789', '０１２３４５６７８９')"
        parts.append({"{k}": "c_custkey::varchar", "{d}": "(c_custkey % 10)::varchar", "{e}": wide}.get(piece, "'" + piece.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"))
    return "(" + " || ".join(parts) + ")"


_HEAD = {"private_url": "https://pan.baidu.com/s/", "phone": "１３８"}


def _variants_sql() -> str:
    rows = []
    for i, (a, x, b, kind, decision, policy) in enumerate(_VARIANTS):
        if kind:
            head = _HEAD.get(kind, "")
            before = f"length({_filled_sql(a)}) - {len(head)}"
            raw = f"('{head}' || {_filled_sql(x)})"
            rows.append(f"select c_custkey as doc_id, '{kind}' as kind, '{decision}' as decision, {'null' if policy is None else repr(policy)} as policy, ({before})::int as start_at, ({before} + length{raw})::int as end_at, {raw} as raw from customer where c_custkey % {len(_VARIANTS)} = {i}")
    return " union all ".join(rows)


@register("labeled_spans", _variants_sql())
def labeled_spans(spark, sf_dir):
    """Spans, decisions and near misses of sentences made from customer keys, all rules at once."""
    text = F.lit(None).cast("string")
    for i, (a, x, b, *_) in enumerate(_VARIANTS):
        text = F.when(K() % len(_VARIANTS) == i, F.concat(_filled(a, K()), _filled(x, K()), _filled(b, K()))).otherwise(text)
    docs = spread(t(spark, sf_dir, "customer").select("c_custkey")).select(K().alias("doc_id"), text.alias("text"))
    s = resolve.select_spans(spans.detect(docs, ["doc_id"], "text"), ["doc_id"])
    return s.select("doc_id", "kind", "decision", "policy", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "raw")


@register("long_credentials", """select c_custkey as doc_id, 'credential' as kind, (case when c_custkey % 200 > 96 then 'credential_too_long' end) as warning, 10::int as start_at, (10 + 4000 + c_custkey % 200)::int as end_at from customer""")
def long_credentials(spark, sf_dir):
    """Secrets of 4,000 to 4,199 characters: one span each, over 4,096 with a warning."""
    docs = spread(t(spark, sf_dir, "customer").select("c_custkey")).select(K().alias("doc_id"), F.concat(F.lit('password="'), F.rpad(F.lit(""), (4000 + K() % 200).cast("int"), F.lit("s")), F.lit('"，说明=rest')).alias("text"))
    found = spans.detect(docs, ["doc_id"], "text", tuple(r for r in RULES if r.kind == "credential"))
    return found.select("doc_id", "kind", "warning", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


# gates

@register("near_label", "select c_custkey as k, c_custkey % 40 + 5 <= 24 as near from customer")
def near_label(spark, sf_dir):
    text = F.concat(F.lit("tel "), F.rpad(F.lit(""), (K() % 40).cast("int"), F.lit("x")), F.lit(" 12345"))
    start = (K() % 40 + 5).cast("int")
    return t(spark, sf_dir, "customer").select(K().alias("k"), tx.near_label(text, start, start + 5, "^tel").alias("near"))


@register("range_overlap", f"{C} select doc_id, seq, (start_ < 9 and 5 < end_) or (start_ < 25 and 20 < end_) as inside from c")
def range_overlap(spark, sf_dir):
    ranges = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((5, 9), (20, 25))])
    return syn.candidates(spark, sf_dir).select("doc_id", "seq", tx.overlaps_any(ranges, F.col("start"), F.col("end")).alias("inside"))


_AFTER = ["，完", " 。", "已确认", "", "\n下一行", " 说"]


@register("clause_final", f"select c_custkey as k, c_custkey % {len(_AFTER)} in (0, 1, 3, 4) as final from customer")
def clause_final(spark, sf_dir):
    return t(spark, sf_dir, "customer").select(K().alias("k"), tx.clause_final(_pick(_AFTER, K())).alias("final"))


_AROUND = [("身份证 ", True), ("身份证，号码 ", False), ("身份证 银行卡 ", False), ("银行卡 证件号码 ", True), ("编号 ", False)]


@register("identity_context", f"select c_custkey as k, c_custkey % 5 in ({', '.join(str(i) for i, (_, b) in enumerate(_AROUND) if b)}) as identity from customer")
def identity_context(spark, sf_dir):
    from ..functions.patterns import IDENTITY_BEFORE

    return t(spark, sf_dir, "customer").select(K().alias("k"), _pick([a for a, _ in _AROUND], K()).rlike(IDENTITY_BEFORE).alias("identity"))


_CLAUSES = [("测试数据 ", "", True), ("测试数据，电话 ", "", False), ("不是测试数据 ", "", False), ("电话 ", " fixture", True), ("电话 ", " now", False)]


@register("technical_context", f"select c_custkey as k, c_custkey % 5 in ({', '.join(str(i) for i, x in enumerate(_CLAUSES) if x[2])}) as technical from customer")
def technical_context(spark, sf_dir):
    return t(spark, sf_dir, "customer").select(K().alias("k"), v.technical_context(_pick([a for a, _, _ in _CLAUSES], K()), _pick([b for _, b, _ in _CLAUSES], K())).alias("technical"))


_PEOPLE = [("张伟明", True), ("付款单", False), ("于近期", False), ("张经理", False), ("华为", False), ("云丽", False), ("欧阳娜娜", True)]


@register("person_values", f"select c_custkey as k, c_custkey % 7 in ({', '.join(str(i) for i, (_, b) in enumerate(_PEOPLE) if b)}) as person from customer")
def person_values(spark, sf_dir):
    return t(spark, sf_dir, "customer").select(K().alias("k"), v.person(_pick([a for a, _ in _PEOPLE], K())).alias("person"))


@register("code_spans", """with c as (select conv_id, turn, length(text) as n, text from conversations where not contains(text, '`') and not contains(text, '~~~'))
    select conv_id, turn, 4::int as start, (n + 14)::int as end from c union all select conv_id, turn, (n + 19)::int, (n + 22)::int from c""")
def code_spans(spark, sf_dir):
    """Ranges of a fenced block and a backtick span around each turn without any of its own."""
    plain = t(spark, sf_dir, "conversations").where(~F.col("text").contains("`") & ~F.col("text").contains("~~~"))
    text = F.concat(F.lit("see\n```py\n"), "text", F.lit("\n```\nand `x` end"))
    return plain.select("conv_id", "turn", F.explode(unicode.code_ranges(text)).alias("r")).select("conv_id", "turn", "r.*")


# model labels and hints

_LABELS = [*neural.LABEL_KINDS, "O"]
_MODEL_NAMES = ["张三", "华为", "John", "王府井", "李四光"]


@register("model_hints", f"""with c as (select p_partkey as id, {_case(_LABELS, 'p_partkey')} as label, {_case(_MODEL_NAMES, 'p_partkey // 3')} as raw from part)
    select id, case label {' '.join(f"when '{a}' then '{b}'" for a, b in neural.LABEL_KINDS.items())} end as kind, raw from c where label <> 'O' and (label <> 'PERSON' or raw in ('张三', '李四光'))""")
def model_hints(spark, sf_dir):
    p = F.col("p_partkey")
    rows = t(spark, sf_dir, "part").select(p.alias("id"), _pick(_LABELS, p).alias("label"), _pick(_MODEL_NAMES, F.floor(p / 3)).alias("raw"))
    return neural.hints(rows).select("id", "kind", "raw")


@register("account_repair", "select c_custkey as k, case when c_custkey % 3 = 2 then null else 'wx_' || c_custkey end as account from customer")
def account_repair(spark, sf_dir):
    raw = F.when(K() % 3 == 0, F.concat(F.lit("账号 wx_"), K().cast("string"), F.lit("，备用"))).when(K() % 3 == 1, F.concat(F.lit("wx_"), K().cast("string"))).otherwise("没有")
    return t(spark, sf_dir, "customer").select(K().alias("k"), neural.first_account(raw).alias("account"))


@register("hint_scores", "select p_partkey as id, greatest(coalesce(case when p_size > 5 then p_size / 50.0 end, 0), (p_partkey % 10) / 10.0)::double as score from part")
def hint_scores(spark, sf_dir):
    evidence = F.when(F.col("p_size") > 5, F.col("p_size") / F.lit(50.0))
    return t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), semantic.hint_score(evidence, (F.col("p_partkey") % 10) / F.lit(10.0)).alias("score"))


@register("distinct_hints", f"{C} select doc_id % 3000 as d, kind, start_ as start_at, end_ as end_at, max(seq / 4.0)::double as score from c group by all")
def distinct_hints(spark, sf_dir):
    c = syn.candidates(spark, sf_dir).withColumn("d", F.col("doc_id") % 3000).withColumn("score", F.col("seq") / F.lit(4.0))
    return semantic.distinct_hints(c, ["d"]).select("d", "kind", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "score")


@register("accepted_reviews", "select conv_id * 100 + turn as id, turn as answer from conversations where turn % 3 <> 1")
def accepted_reviews(spark, sf_dir):
    """Results of two in three turns: the others answer an older text."""
    c = t(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "turn", "text")
    old = F.when(F.col("turn") % 3 == 1, F.concat("text", F.lit("?"))).otherwise(F.col("text"))
    return semantic.accepted_reviews(c, c.select("id", F.sha2(old, 256).alias("digest"), F.col("turn").alias("answer")), "id").select("id", "answer")


# settings

def _settings_json() -> tuple[list[str], list[bool]]:
    many = '["' + '","'.join(f"t{i}" for i in range(101)) + '"]'
    cases = [
        ('{"mode":"replace","terms":["a","b"]}', True), ('{"mode":"mask","terms":["a"]}', False), ('{"mode":"block","terms":["a"," a"]}', False), ('{"mode":"block"}', False), ("not json", False),
        ('{"mode":"replace","terms":[],"detectionProfile":"balanced","semanticReview":"off"}', True), ('{"mode":"replace","terms":[],"detectionProfile":"wild"}', False),
        ('{"mode":"replace","terms":[],"categoryPolicies":[{"kind":"phone","action":"block"}]}', True), ('{"mode":"replace","terms":[],"categoryPolicies":[{"kind":"phone","action":"block"},{"kind":"phone","action":"confirm"}]}', False),
        ('{"mode":"replace","terms":[],"categoryPolicies":[{"kind":"shoe","action":"block"}]}', False), ('{"mode":"replace","terms":[],"siteAllowlist":[{"value":"v","siteId":"s","expiresAt":"2030-01-01T00:00:00Z"}]}', True),
        ('{"mode":"replace","terms":[],"siteAllowlist":[{"value":"v","siteId":"s","expiresAt":"soon"}]}', False), ('{"mode":"replace","terms":[],"auditEnabled":true}', True), ('["a","b"]', True), ('["a",""]', False), ('{"mode":"replace","terms":' + many + "}", False),
    ]
    return [c for c, _ in cases], [b for _, b in cases]


_JSON, _GOOD = _settings_json()
_GOOD_SQL = f"c_custkey % {len(_GOOD)} in ({', '.join(str(i) for i, b in enumerate(_GOOD) if b)})"


@register("settings_valid", f"select c_custkey as k, {_GOOD_SQL} as valid from customer")
def settings_valid(spark, sf_dir):
    return t(spark, sf_dir, "customer").select(K().alias("k"), settings.validity(_pick(_JSON, K())).alias("valid"))


@register("imported_settings", f"""select c_custkey as k, case when c_custkey // 16 % 4 = 1 then 'unsupported_schema' when c_custkey // 16 % 4 = 2 then 'invalid_configuration' when c_custkey // 16 % 4 = 3 or c_custkey % 16 = 4 then 'invalid_json'
    when not ({_GOOD_SQL}) or c_custkey % 16 = 13 then 'invalid_configuration' end as error from customer where c_custkey % 16 <> 13 or c_custkey // 16 % 4 > 0""")
def imported_settings(spark, sf_dir):
    turn = F.floor(K() / 16) % 4
    envelope = F.when(turn == 1, '{"schemaVersion":2,"settings":{}}').when(turn == 2, '{"settings":{}}').when(turn == 3, "{").otherwise(F.concat(F.lit('{"schemaVersion":1,"settings":'), _pick(_JSON, K()), F.lit("}")))
    d = t(spark, sf_dir, "customer").where((K() % 16 != 13) | (turn > 0)).select(K().alias("k"), envelope.alias("j"))
    return settings.imported(d, "j").select("k", "error")


@register("imported_allowlists", """
    with a as (select c_name as value, 's' || (c_custkey % 5) as site_id, timestamp '2030-01-01' + to_days((c_custkey % 30)::int) as expires_at from customer where c_custkey % 2 = 0),
      b as (select c_name as value, 's' || (c_custkey % 5) as site_id, timestamp '2030-01-01' + to_days((c_custkey % 17)::int) as expires_at from customer where c_custkey % 3 = 0)
    select 'merge' as mode, value, site_id, max(expires_at) as expires_at from (select * from a union all select * from b) group by all union all select 'replace', * from b""")
def imported_allowlists(spark, sf_dir):
    def side(m: int, d: int) -> DataFrame:
        return t(spark, sf_dir, "customer").where(K() % m == 0).select(F.col("c_name").alias("value"), F.concat(F.lit("s"), (K() % 5).cast("string")).alias("site_id"), F.timestamp_add("DAY", (K() % d).cast("int"), F.lit("2030-01-01").cast("timestamp")).alias("expires_at"))

    out = [settings.import_allowlists(side(2, 30), side(3, 17), m).select(F.lit(m).alias("mode"), "*") for m in ("merge", "replace")]
    return out[0].unionByName(out[1])


@register("term_lists", """select c_custkey as k, 'a,b,n' || (c_custkey % 3) as merged, case when c_custkey % 3 = 0 then 'b' else 'a,b' end as rest, case when c_custkey % 2 = 0 then 'a' else '' end as both from customer""")
def term_lists(spark, sf_dir):
    """Ordered union, difference and intersection of term lists."""
    one = F.array(F.lit("a"), F.lit(" b"), F.lit("a "))
    two = F.array(F.lit("b"), F.concat(F.lit("n"), (K() % 3).cast("string")), F.lit(" "))
    rest = settings.without_term(F.array(F.lit("a"), F.lit("b")), F.when(K() % 3 == 0, " a ").otherwise("c"))
    both = F.array_intersect(F.array(F.lit("a"), F.lit("b")), F.array(F.when(K() % 2 == 0, "a").otherwise("z")))
    return t(spark, sf_dir, "customer").select(K().alias("k"), F.concat_ws(",", settings.term_union(one, two)).alias("merged"), F.concat_ws(",", rest).alias("rest"), F.concat_ws(",", both).alias("both"))


@register("settings_envelope", """select c_custkey as k, '{"schemaVersion":1,"settings":{"mode":"replace","n":' || c_custkey || '}}' as envelope from customer""")
def settings_envelope(spark, sf_dir):
    d = t(spark, sf_dir, "customer").select(K().alias("k"), F.struct(F.lit("replace").alias("mode"), K().alias("n")).alias("s"))
    return settings.export(d, "s").select("k", "envelope")


@register("preset_decisions", f"{C} select doc_id, seq, case when kind in ('phone', 'email') then 'block' else decision end as decision from c")
def preset_decisions(spark, sf_dir):
    pack = {"categoryPolicies": [{"kind": "phone", "action": "confirm"}, {"kind": "email", "action": "block"}]}
    return resolve.with_policy(syn.candidates(spark, sf_dir), settings.preset_policies(spark, pack)).select("doc_id", "seq", "decision")


# OCR texts

@register("joined_words", """
    with w as (select p_partkey // 7 as page, p_partkey as n, case when p_partkey % 2 = 0 then '中文' else 'id' || p_size end as text, (p_partkey % 4 * 30)::double as x0, (p_partkey % 4 * 30 + 24)::double as x1, (p_partkey // 4 * 40)::double as y0, (p_partkey // 4 * 40 + 10)::double as y1 from part),
      b as (select *, lag(x1) over o as px1, lag(y0) over o as py0, lag(text) over o as pt from w window o as (partition by page order by n)),
      g as (select *, case when pt is null then '' when py0 = y0 and x0 - px1 between -2.5 and 20 then ' ' else chr(10) end as gap from b)
    select page, string_agg(gap || text, '' order by n) as text, string_agg(case when gap = ' ' and (right(pt, 1) = '文') = (left(text, 1) = '中') then '' else gap end || text, '' order by n) as compact from g group by page""")
def joined_words(spark, sf_dir):
    n = F.col("p_partkey")
    at = lambda c: c.cast("double")
    w = t(spark, sf_dir, "part").select(
        F.floor(n / 7).alias("page"), n.alias("n"), F.when(n % 2 == 0, "中文").otherwise(F.concat(F.lit("id"), F.col("p_size").cast("string"))).alias("text"),
        at(n % 4 * 30).alias("x0"), at(n % 4 * 30 + 24).alias("x1"), at(F.floor(n / 4) * 40).alias("y0"), at(F.floor(n / 4) * 40 + 10).alias("y1"),
    )
    return ocr.joined_words(w, ["page"], "n")


@register("compact_ranges", f"{C} select doc_id, seq from c q where seq >= 3 and not exists (select 1 from c g where g.seq < 3 and g.doc_id = q.doc_id and g.kind = q.kind and g.start_ < q.end_ and q.start_ < g.end_)")
def compact_ranges(spark, sf_dir):
    c = syn.candidates(spark, sf_dir)
    return ocr.extra_ranges(c.where("seq >= 3"), c.where("seq < 3"), ["doc_id"]).select("doc_id", "seq")


@register("ocr_kind_counts", f"{C} select doc_id % 200 as page, kind, count(*) as n from c group by all")
def ocr_kind_counts(spark, sf_dir):
    return syn.candidates(spark, sf_dir).groupBy((F.col("doc_id") % 200).alias("page"), "kind").agg(F.count("*").alias("n"))


# reports

@register("finding_summary", f"{C} select doc_id % 100 as g, kind, count(*) as n, string_agg(distinct source, ',' order by source) as labels, bool_or(policy is not null) as inferred from c where source is not null group by all")
def finding_summary(spark, sf_dir):
    c = syn.candidates(spark, sf_dir).where("source is not null").groupBy("doc_id", "kind", F.col("source").alias("label")).agg(F.count("*").alias("n"), F.bool_or(F.col("policy").isNotNull()).alias("inferred"))
    return findings.summary(c.withColumn("g", F.col("doc_id") % 100), ["g"])


@register("run_stats", "select count(*) as documents, count(*) filter (where o_custkey % 4 > 0) as primed, sum(o_custkey % 4)::bigint as hints, avg((o_orderkey % 50)::double) as ms_per_document from orders")
def run_stats(spark, sf_dir):
    d = t(spark, sf_dir, "orders").select((F.col("o_custkey") % 4).alias("hints"), (F.col("o_orderkey") % 50).cast("double").alias("ms"))
    return findings.run_stats(d, "hints", "ms")


@register("span_examples", f"{C} select kind, doc_id, seq from (select *, row_number() over (partition by kind order by doc_id, seq) as rn from c) where rn <= 8")
def span_examples(spark, sf_dir):
    return findings.examples(syn.candidates(spark, sf_dir), ["kind"], ["doc_id", "seq"]).select("kind", "doc_id", "seq")


@register("first_documents", "select doc_id, length(text)::int as n from documents order by doc_id, text limit 50")
def first_documents(spark, sf_dir):
    """The documents that an evaluation of limited size takes (the limit is the feature)."""
    return t(spark, sf_dir, "documents").orderBy("doc_id", "text").limit(50).select("doc_id", F.length("text").alias("n"))


@register("prediction_files", f"{C} select doc_id, kind, start_ as start_at, end_ as end_at, case when seq < 3 then 'rules' else 'model' end as arm from c")
def prediction_files(spark, sf_dir):
    """Predictions written as JSON lines, a folder for each arm, and read again."""
    c = syn.candidates(spark, sf_dir)
    path = scratch(spark, "predictions")
    sinks.write_predictions(c.select("doc_id", "kind", F.col("start").alias("start_at"), F.col("end").alias("end_at"), F.when(F.col("seq") < 3, "rules").otherwise("model").alias("arm")), path)
    return spark.read.schema("doc_id long, kind string, start_at int, end_at int, arm string").json(path)


@register("redacted_files", "select case when o_orderkey % 3 = 0 then 'clear ' || o_orderkey else '[[PHONE_001]] ' || o_orderkey end as line from orders where o_orderkey % 4 > 0")
def redacted_files(spark, sf_dir):
    """Redacted texts, one a line, blocked ones left out, read again."""
    o = F.col("o_orderkey")
    path = scratch(spark, "redacted")
    sinks.write_redacted(t(spark, sf_dir, "orders").select(F.when(o % 4 > 0, F.concat(F.when(o % 3 == 0, "clear ").otherwise("[[PHONE_001]] "), o.cast("string"))).alias("outbound_text")), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@register("kind_dimension_use", f"{C} select kind, count(*) as n, min(case kind {' '.join(f'when {k[0]!r} then {k[1]}' for k in kinds.KINDS)} end)::double as priority from c group by 1")
def kind_dimension_use(spark, sf_dir):
    return syn.candidates(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n")).join(F.broadcast(kinds.kind_table(spark).select("kind", "priority")), "kind")


# streams

@register("stream_findings", f"""with {found_sql()} select doc_id, kind, count(*) as n, any_value(decision) as decision from found group by 1, 2""")
def stream_findings(spark, sf_dir):
    """Documents as a stream, detected batch by batch."""
    docs = spark.readStream.schema(t(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parque[t]")
    out = scratch(spark, "findings")
    detect_stream(docs.select("doc_id", "text"), ["doc_id"], "text", out, scratch(spark, "state"), TOLD)
    return spark.read.parquet(out).select("doc_id", "kind", "n", "decision")


@register("live_settings", f"""with {found_sql()} select doc_id, kind, count(*) as n, doc_id % 2 = 1 and kind = 'email' as blocked from found group by 1, 2
    union all select doc_id, 'custom_term', len(regexp_extract_all(text, 'zq7live')), false from (select doc_id, case when doc_id % 4 < 2 then 'zq7live' else 'other' end as text from documents) where doc_id % 2 = 1 and text = 'zq7live'""")
def live_settings(spark, sf_dir):
    """A stream over two runs whose settings change between them: odd documents come later, under a policy and with a term that even ones didn't have."""
    d = F.col("doc_id")
    docs = t(spark, sf_dir, "documents").select("doc_id", F.concat(F.when(d % 4 < 2, "zq7live").otherwise("other"), F.lit("\n"), "text").alias("text"))
    given, out, state, kept = (scratch(spark, w) for w in ("arrivals", "findings", "state", "settings"))

    def live():
        now = spark.read.schema("terms array<string>, kind string, action string").json(kept)
        return [x for r in now.select(F.explode_outer("terms").alias("x")).where("x is not null").distinct().collect() for x in r], now.where("kind is not null").select("kind", "action")

    for odd, setting in ((0, '{"terms": []}'), (1, '{"terms": ["zq7live"], "kind": "email", "action": "block"}')):
        spark.range(1).select(F.lit(setting).alias("value")).write.mode("overwrite").text(kept)
        docs.where(d % 2 == odd).write.mode("append").parquet(given)
        detect_stream(spark.readStream.schema(docs.schema).parquet(given), ["doc_id"], "text", out, state, TOLD, live)
    found = spark.read.parquet(out)
    return found.select("doc_id", "kind", "n", (F.coalesce("policy", F.lit("")) == "block").alias("blocked"))


# evaluation

@register("context_leaks", r"""
    with d as (select doc_id, text, case when doc_id % 7 = 1 then ['V' || (doc_id % 130), 'Zhang Weiming'] else ['V' || (doc_id % 100)] end as vals from documents),
      e as (select d.doc_id, case when d.doc_id % 3 = 0 then left(p.text, length(p.text) // 2) || 'Zhang Weiming' || substr(p.text, length(p.text) // 2 + 1) || ' V' || (d.doc_id % 130) else d.text end as text, vals from d left join documents p on p.doc_id = d.doc_id - 1 where d.doc_id % 7 = 1),
      k as (select doc_id, regexp_replace(replace(replace(text, vals[1], ''), 'Zhang Weiming', ''), '[^\p{L}\p{N}]+', '', 'g') as s, vals from e),
      c as (select distinct regexp_replace(replace(text, vals[1], ''), '[^\p{L}\p{N}]+', '', 'g') as s from d where doc_id % 7 <> 1),
      r as (select doc_id, coalesce(s <> '' and s in (select s from c where s is not null), false) as same_context, vals[1] in (select vals[1] from d where doc_id % 7 <> 1) as same_value from k)
    select * from r where same_context or same_value""")
def context_leaks(spark, sf_dir):
    """Evaluation texts, a third of them the training text before with values put in: known by their skeleton or by a value."""
    d = F.col("doc_id")
    docs = t(spark, sf_dir, "documents").select("doc_id", "text")
    train = docs.where("doc_id % 7 <> 1").select("text", F.array(F.concat(F.lit("V"), (d % 100).cast("string"))).alias("values"))
    value, half = F.concat(F.lit("V"), (d % 130).cast("string")), F.floor(F.length("before") / 2).cast("int")
    planted = F.concat(F.left("before", half), F.lit("Zhang Weiming"), F.substring("before", half + 1, F.length("before")), F.lit(" "), value)
    before = docs.select((d + 1).alias("doc_id"), F.col("text").alias("before"))
    asked = docs.where("doc_id % 7 = 1").join(before, "doc_id", "left").select("doc_id", F.when(d % 3 == 0, planted).otherwise(F.col("text")).alias("text"), F.array(value, F.lit("Zhang Weiming")).alias("values"))
    return evaluate.leaks(train, asked, ["doc_id"])
