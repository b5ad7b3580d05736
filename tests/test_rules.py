"""Spans of single sentences: the normalized view, code, context, credentials of any length, names and addresses. Inputs and values are fixed cases that must match."""

import unicodedata

import pytest

from hushgrid.functions import unicode
from hushgrid.functions.patterns import RULES
from hushgrid.operators import findings, redact, resolve, spans

LONG = "x" * 5000
CASES = [
    ("麻烦联系张 默 言处理。", {("person_name", "张 默 言")}),
    ("客戶歐陽娜娜會跟進。", {("person_name", "歐陽娜娜")}),
    ("收件人是张⁦默️言，下午送达。", {("person_name", "张⁦默️言")}),
    ("后续由阿不都热西提负责。", {("person_name", "阿不都热西提")}),
    ("请张默言确认预算。", {("person_name", "张默言")}),
    ("让欧阳娜娜审核合同。", {("person_name", "欧阳娜娜")}),
    ("资料放在北京市海淀区中关村软件园二期3号楼1201。", {("address", "北京市海淀区中关村软件园二期3号楼1201")}),
    ("請寄到臺北市信義區松仁路100號12樓。", {("address", "臺北市信義區松仁路100號12樓")}),
    ("地址是上海市浦东新区世纪大道88号，到了联系我。", {("address", "上海市浦东新区世纪大道88号")}),
    ("请联系华为处理云服务故障。", set()),
    ("请联系张总确认预算。", set()),
    ("上海市浦东新区世纪大道88号附近开了新店。", {("address", "上海市浦东新区世纪大道88号")}),
    # the view
    ("ｐａｓｓｗｏｒｄ＝ａｌｐｈａ​，ｂｅｔａ", {("credential", "ａｌｐｈａ​，ｂｅｔａ")}),
    ("電話 １３８００１３８０００ 請記", {("phone", "１３８００１３８０００")}),
    ("mail a​b@c.io now", {("email", "a​b@c.io")}),
    ("call 138–0013–8000 now", {("phone", "138–0013–8000")}),
    # code
    ("```\n我叫李建国，你好\n```", set()),
    ("看 `我叫李建国，` 完", set()),
    ("我叫李建国，你好", {("person_name", "李建国")}),
    ("`x` token=abcdef", {("credential", "abcdef")}),
    # credentials
    (f'password="{LONG}"，说明=keep-this-text', {("credential", spans.OMITTED)}),
    (f"password={LONG}", {("credential", spans.OMITTED)}),
    (f"password={LONG[:4096]}", {("credential", LONG[:4096])}),
    ('password="a b, \\"c" rest', {("credential", 'a b, \\"c')}),
    ("密码：hunter2，手机号：13800138000", {("credential", "hunter2"), ("phone", "13800138000")}),
    ("secret=[[CREDENTIAL_001]]", set()),
    ("mypassword=abc", set()),
    # share links, dates, cards, IDs, spoken numbers
    ("see https://pan.baidu.com/s/abcdefgh12. Then go", {("private_url", "https://pan.baidu.com/s/abcdefgh12")}),
    ("https://www.dropbox.com/home", set()),
    ("生日：1990-13-45", set()),
    ("生日：1990-12-05", {("private_date", "1990-12-05")}),
    ("校验码 4111 1111 1111 1111 结束", set()),
    ("身份证 4111111111111111 结束", set()),
    ("付款用 6200000000000000 吧", {("bank_card", "6200000000000000")}),
    ("订单 6200000000000000 号", set()),
    ("手机号码报一下 幺三八零零幺三八零零零。", {("phone", "幺三八零零幺三八零零零")}),
    ("手机的测试数据 幺三八零零幺三八零零零。", set()),
    ("随便 幺三八零零幺三八零零零。", set()),
    # labels
    ("收件人 沈砚，电话 138", {("person_name", "沈砚")}),
    ("对接人 方案已确认", set()),
    ("负责人：付款单。", set()),
    ("合同编号：" + "9" * 121, set()),
    ("李建国负责此事", {("person_name", "李建国")}),
    ("这个项目由张默言负责，请安排下周会议。", {("person_name", "张默言")}),
    ("请把材料寄送至陕西省西安市碑林区友谊西路128号。", {("address", "陕西省西安市碑林区友谊西路128号")}),
    ("我的微信是 demo_wechat_01，方便时加我。", {("account", "demo_wechat_01")}),
    ("测试环境数据库密码是 synthetic-demo-secret。", {("credential", "synthetic-demo-secret")}),
    ("这个普通项目需要在下周完成评审。", set()),
    ("请联系 １３８\u200B００１３\u200D８０００。", {("phone", "１３８\u200B００１３\u200D８０００")}),
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id int, text string")
    chosen = resolve.select_spans(spans.detect(docs, ["doc_id"], "text"), ["doc_id"])
    return docs, spark.createDataFrame(chosen.collect(), chosen.schema)


def test_spans_of_cases(found):
    got = {}
    for r in found[1].collect():
        got.setdefault(r.doc_id, set()).add((r.kind, r.raw))
    wrong = [(t[:60], want, got.get(i, set())) for i, (t, want) in enumerate(CASES) if got.get(i, set()) != want]
    assert not wrong, wrong


def test_long_secrets_leave_nothing(found):
    docs, chosen = found
    out = {r.doc_id: r for r in redact.redact(docs, chosen, ["doc_id"], ["doc_id"]).collect()}
    for i, (t, _) in enumerate(CASES):
        if LONG in t:
            assert "xx" not in out[i].redacted_text and out[i].status == "blocked"
        if "keep-this-text" in t:
            assert out[i].redacted_text.endswith('"，说明=keep-this-text')
    told = {r.doc_id: r.warning for r in findings.findings(chosen, ["doc_id"]).collect() if r.warning}
    assert set(told.values()) == {"credential_too_long"} and len(told) == 2


def test_offsets_are_of_the_source(found):
    texts = dict(enumerate(t for t, _ in CASES))
    assert all(r.raw in (texts[r.doc_id][r.start : r.end], spans.OMITTED) for r in found[1].collect())


def test_texts_of_the_same_length_are_what_the_view_is(spark):
    """Every character that the class of changed ones leaves out is replaced one by one, as the view does."""
    chars = [chr(c) for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    rows = df.where(~df.c.rlike(unicode.CHANGED)).select("c", unicode.same_length_view(df.c).alias("v")).collect()
    wrong = [(hex(ord(r.c)), r.v, unicode.view_of(r.c)[0]) for r in rows if r.v != unicode.view_of(r.c)[0]]
    assert not wrong and len(rows) > 40_000


def test_hits_in_texts_with_the_mark(spark):
    """A text that holds the code point at which texts are cut is cut by the pattern itself."""
    texts = ["\uffffa.b@c.io\uffff, x@y.org\uffff 密码：hunter2", "a.b@c.io, x@y.org", "密码：hunter2，密码：hunter3", "\uffff"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = spans.detect(df, ["doc_id"], "text", tuple(r for r in RULES if r.kind in ("email", "credential"))).orderBy("doc_id", "start").collect()
    assert [(r.doc_id, r.raw) for r in rows] == [(0, "a.b@c.io"), (0, "x@y.org"), (0, "hunter2"), (1, "a.b@c.io"), (1, "x@y.org"), (2, "hunter2"), (2, "hunter3")]
    assert all(texts[r.doc_id][r.start : r.end] == r.raw for r in rows)


def test_mac_addresses_of_letters_alone(spark):
    df = spark.createDataFrame([(1, "device AB:CD:EF:AB:CD:EF up")], "doc_id int, text string")
    assert [(r.kind, r.raw) for r in spans.detect(df, ["doc_id"], "text").collect()] == [("mac_address", "AB:CD:EF:AB:CD:EF")]


def test_rows_of_a_rule_do_not_compile_it(spark):
    """Splitting by a long pattern compiles it for each row, which takes milliseconds; texts are cut at a mark."""
    df = spark.createDataFrame([(1, "联系人：张伟明，已确认")], "doc_id int, text string")
    plan = spans.detect(df, ["doc_id"], "text", tuple(r for r in RULES if r.kind == "person_name"))._jdf.queryExecution().optimizedPlan().toString()
    assert "\uffff" in plan


def test_runs_left_out_are_what_the_view_is():
    """What ``unusual`` takes out stands in the view as it is."""
    plain = [chr(c) for c in (*range(0x80), *range(0xBF, 0x132), *range(0x4E00, 0xA000))]
    assert not set(plain) & set(unicode.ONE_TO_ONE[0]) and unicode.view_of("中" + "".join(plain))[0] == "中" + "".join(plain)
