"""Addresses by structure, accounts in context, names beside values, and values of very many parts."""

import random
import re

import pytest

from hushgrid.functions import places
from hushgrid.functions.patterns import RULES
from hushgrid.operators import resolve, spans

# Fixed cases that must match.
ADDRESSES = [
    ("资料放在北京市海淀区中关村软件园二期3号楼1201。", ["北京市海淀区中关村软件园二期3号楼1201"]),
    ("請寄到臺北市信義區松仁路100號12樓。", ["臺北市信義區松仁路100號12樓"]),
    ("上海市浦东新区世纪大道88号附近开了新店。", ["上海市浦东新区世纪大道88号"]),
    ("请把合同寄到广东省深圳市南山区科技园科苑路15号B座1203室。", ["广东省深圳市南山区科技园科苑路15号B座1203室"]),
    ("家住西安市碑林区友谊西路128号，今天不在。", ["西安市碑林区友谊西路128号"]),
    ("在上海浦东世纪大道88号碰面。", ["上海浦东世纪大道88号"]),
    ("浙江杭州西湖文三路 200 号", ["浙江杭州西湖文三路 200 号"]),
    ("武汉市洪山区霁虹街95号", ["武汉市洪山区霁虹街95号"]),
    ("改为上海市浦东新区世纪大道 100 号", ["上海市浦东新区世纪大道 100 号"]),
    # the right edge: clocks, prose, other numbers
    ("朝阳门外大街 88 号 8 点见", ["朝阳门外大街 88 号"]),
    ("灵隐路 168 号的民宿 5月20日入住 房东 张姐 13901234567", ["灵隐路 168 号"]),
    ("学院路 17 号 订单号 ORD-4257", ["学院路 17 号"]),
    ("朝阳望京街 6 号望京 SOHO T1 B 座 1701 130", ["朝阳望京街 6 号望京 SOHO T1 B 座 1701"]),
    ("货到了 收件人 周晓宇 18811223344 杭州西湖区文三路 100 号", ["杭州西湖区文三路 100 号"]),
    ("在您小区 朝阳门外大街 88 号", ["朝阳门外大街 88 号"]),
    # no address
    ("到市场部会议室3楼开会", []),
    ("山的路上遇到一个采药的老乡", []),
    ("顺路去超市3楼", []),
    ("上海很大，路很长。", []),
]


@pytest.mark.parametrize("text,want", ADDRESSES)
def test_addresses(text, want):
    assert [text[a:b] for a, b in places.addresses(text, [])] == want


def test_addresses_leave_code_out_and_end_at_the_bound():
    text = "`上海市浦东新区世纪大道88号` 上海市浦东新区世纪大道88号"
    assert places.addresses(text, [(0, 16)]) == [(17, 31)]
    long = "上海市浦东新区" + "东" * 200 + "路88号"
    assert all(b - a <= places.LONGEST for a, b in places.addresses(long, []))


def test_gazetteer_finds_the_longest_name_that_ends_at_a_place():
    rng = random.Random(1)
    names = places.both_scripts([*places.PROVINCES, *places.CITIES, *places.DISTRICTS])
    for _ in range(300):
        text = "".join(rng.choice([*names, "在", "的", "路"]) for _ in range(4))
        for end in range(len(text) + 1):
            assert places.KNOWN.ending_at(text, end) == max((len(n) for n in names if text[:end].endswith(n)), default=0)
    assert "內蒙古" in names and "臺北" in names and "台北" in names and "東城" in names


def found(spark, texts, kind=None):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = resolve.select_spans(spans.detect(df, ["id"], "text"), ["id"]).collect()
    return [sorted((r.start, r.kind, r.raw) for r in rows if r.id == i and kind in (None, r.kind)) for i in range(len(texts))]


ACCOUNTS = [
    ("先搜 demo_user88 再说", ["demo_user88"]),
    ("备用账号是 wx_lin2020。", ["wx_lin2020"]),
    ("会话入口改成 小林_0915", ["小林_0915"]),
    ("对接窗口切到 lin.moyan01", ["lin.moyan01"]),
    ("页面显示 lin_2020，就这样", ["lin_2020"]),
    ("对接窗口切到 lin.moyan", []),
    ("请在群里加 @moyan_zhang 聊", ["@moyan_zhang"]),
    ("私聊 @moyan_zhang 说", ["@moyan_zhang"]),
    ("联系人的账号记为 sample_user，别忘", ["sample_user"]),
    ("加 12345 好友", ["12345"]),
    # one span where several patterns find the value
    ("账号：lin2020，备用账号是lin2020", ["lin2020", "lin2020"]),
    # not accounts
    ("这不是账号，订单 demo_user88", []),
    ("变量名 handle 是 sample_user 测试", []),
    ("看到 password，就是", []),
    ("通过 message 通知", []),
    ("加 13800138000", []),
    ("看到 lin2020 后走了", []),
    ("`先搜 demo_user88`", []),
    ("搜 1234", []),
]


def test_accounts_in_context(spark):
    got = found(spark, [t for t, _ in ACCOUNTS], "account")
    for (text, want), spans_ in zip(ACCOUNTS, got):
        assert [r for _, _, r in spans_] == want, text


def test_many_accounts_in_one_text_are_settled_beside_each_other(spark):
    text = "，".join(f"先搜 user_{i:05d}" for i in range(3000))
    assert len(found(spark, [text], "account")[0]) == 3000


NAMES = [
    ("郭静13800138000", ["郭静"]),
    ("13800138000，是沈砚", ["沈砚"]),
    ("微信加沈砚 a_b@c.io", ["沈砚"]),
    ("沈砚的手机号 13800138000", ["沈砚"]),
    ("名单：沈砚/13800138000、岑湛/13900139000", ["沈砚", "岑湛"]),
    ("方案13800138000", []),
    ("沈砚说过 没有号码", []),
    ("李白 13800138000 历史展", []),
]


def test_names_beside_values(spark):
    got = found(spark, [t for t, _ in NAMES], "person_name")
    for (text, want), spans_ in zip(NAMES, got):
        assert [r for _, _, r in spans_] == want, text


PARTS = {
    "email": "a@b" + ".c" * 100_000,
    "obfuscated": "abc_at_d" + "_dot_com" * 100_000,
    "unix": "/home/u" + "/a" * 100_000,
    "windows": "C:\\Users\\u" + "\\a" * 100_000,
    "key": "-----BEGIN" + " A" * 100_000 + " PRIVATE KEY-----\nx\n-----END" + " A" * 100_000 + " PRIVATE KEY-----",
    "open key": "-----BEGIN" + " A" * 100_000,
    "quoted": 'password="' + '\\"x' * 100_000 + '"',
    "open quote": 'password="' + '\\"x' * 100_000,
    "blanks": "password=x" + " " * 100_000 + "y",
    "bearer": "Bearer " + "a." * 100_000,
    "url": "postgres://" + "a/" * 100_000,
    "share": "https://drive.google.com/" + "a/" * 100_000,
    "token": "eyJaaaaaa." + "aaaaaa." * 100_000,
    "spoken": "手机 " + "幺 " * 100_000,
    "digits": "身份证 付款 " + "1 " * 100_000,
    "address": "上海市" + "浦东新区世纪大道" * 20_000 + "，上海市浦东新区世纪大道88号",
    "name": "客户" + "张 " * 100_000,
    "account": "账号" + "账号" * 50_000 + "是a",
    "handle": "加 " + "a." * 100_000,
    "ipv6": "a:" * 100_000,
    "mac": "aa:" * 100_000,
    "court": "（2020）" + "京" * 100_000,
}


def test_values_of_very_many_parts_end(spark):
    texts = [p + " 尾 x@y.io" for p in PARTS.values()]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(len(texts), "id")
    rows = spans.detect(df, ["id"], "text").select("id", "kind").distinct().collect()
    got = {n: {r.kind for r in rows if r.id == i} for i, n in enumerate(PARTS)}
    for name, kind in {"email": "email", "unix": "local_path", "windows": "local_path", "key": "private_key", "quoted": "credential", "obfuscated": "email", "address": "address"}.items():
        assert kind in got[name], name


def test_every_rule_with_an_unbounded_group_repeats_it_possessively():
    for r in RULES:
        for m in re.finditer(r"(?<!\\)\)([*+]|\{\d+,\})(?!\+)", r.pattern):
            raise AssertionError(f"{r.kind}: {r.pattern[max(0, m.start() - 30) : m.end()]}")


def test_hints_without_a_text_or_a_place(spark):
    from hushgrid.operators import hints

    texts = spark.createDataFrame([(1, None), (2, "生日 1990-02-11 记"), (3, "")], "id long, text string")
    given = spark.createDataFrame([(1, "email", 0, 3), (2, "private_date", 3, 14), (2, "private_date", 3, 99), (2, "private_date", -1, 5), (2, "person_name", 2, 3), (2, "other", 3, 13), (3, "email", 0, 1), (9, "email", 0, 1)], "id long, kind string, start int, end int")
    out = hints.as_candidates(given, texts, ["id"], "text", 2026)
    assert [(r.id, r.kind, r.start, r.end, r.raw) for r in out.collect()] == [(2, "private_date", 3, 13, "1990-02-11")]
    none = spark.createDataFrame([], out.drop("valid_id").schema)
    assert [r.raw for r in hints.with_hints(none, out, ["id"]).collect()] == ["1990-02-11"]
    assert hints.with_hints(none, out.limit(0), ["id"]).count() == 0
