"""Addresses by their structure: a gazetteer walked from right to left, and a grammar of components to the right edge.

A start is a place behind a word that leads to an address, or a division or road name found from its suffix backwards. From
there a segment runs to the first mark, tail word or foreign character, ``LONGEST`` characters at most. Its
tokens are read once: named components open the chain and prolong it, numbers, short Latin codes and units
prolong it where they follow, and prose ends it unless a component follows. What the chain covers is an address if it has enough parts.
"""

from __future__ import annotations

import re

# Place names, suffixes and words around addresses.
PROVINCES = (
    "内蒙古 黑龙江 浙江 江苏 广东 山东 河南 河北 湖南 湖北 福建 安徽 江西 辽宁 吉林 陕西 山西 甘肃 青海 云南 贵州 广西 新疆 西藏 宁夏 海南 四川 台湾".split()
)
CITIES = (
    "哈尔滨 石家庄 乌鲁木齐 呼和浩特 北京 上海 天津 重庆 广州 深圳 南京 杭州 武汉 成都 西安 苏州 长沙 郑州 青岛 厦门 宁波 福州 合肥 昆明 南昌 "
    "济南 大连 沈阳 太原 贵阳 南宁 海口 兰州 拉萨 银川 西宁 台北 香港 澳门"
).split()
DISTRICTS = (
    "海淀 朝阳 东城 西城 丰台 石景山 通州 顺义 昌平 大兴 房山 门头沟 怀柔 平谷 密云 延庆 "
    "浦东 徐汇 黄浦 静安 长宁 普陀 虹口 杨浦 闵行 宝山 嘉定 松江 青浦 奉贤 崇明 金山 "
    "天河 越秀 荔湾 海珠 番禺 白云 黄埔 南沙 增城 从化 福田 南山 罗湖 宝安 龙岗 龙华 坪山 光明 盐田 "
    "西湖 拱墅 上城 下城 江干 滨江 萧山 余杭 临安 玄武 秦淮 鼓楼 建邺 栖霞 雨花台 江宁 六合 溧水 姑苏 虎丘 吴中 相城 吴江 昆山 崑山 "
    "武侯 青羊 锦江 金牛 成华 龙泉驿 温江 郫都 双流 渝中 沙坪坝 南岸 九龙坡 渝北 巴南 北碚 大渡口 洪山 武昌 汉阳 江岸 江汉 硚口 青山 蔡甸 东西湖 "
    "雁塔 碑林 莲湖 未央 灞桥 新城 长安 阎良 和平 河西 南开 河东 河北 红桥 西青 津南 东丽 北辰 历下 槐荫 市中 天桥 历城 章丘 "
    "岳麓 芙蓉 天心 雨花 开福 望城 蜀山 庐阳 包河 瑶海 肥东 肥西 思明 湖里 集美 海沧 同安 翔安 "
    "鄞州 海曙 江北 镇海 北仑 奉化 慈溪 金水 二七 管城 惠济 中原 上街 沈河 铁西 皇姑 大东 浑南"
).split()
LONG_DIVISIONS = "黑龙江省 内蒙古自治区 新疆维吾尔自治区 宁夏回族自治区 广西壮族自治区 西藏自治区 香港特别行政区 澳门特别行政区".split()
#: Simplified characters of these names and the traditional ones that may stand for them.
SIMPLIFIED = "内龙苏广东辽宁陕肃云贵湾尔滨庄乌鲁齐庆汉长郑岛厦济连沈阳兰萨银门丰顺义头沟怀汇黄静杨闵宝贤从罗岗华盐萧余临楼邺栖吴锦驿温双坝莲桥阎开红丽历荫岳庐瑶里沧镇仑铁浑台马硚"
TRADITIONAL = "內龍蘇廣東遼寧陝肅雲貴灣爾濱莊烏魯齊慶漢長鄭島廈濟連瀋陽蘭薩銀門豐順義頭溝懷匯黃靜楊閔寶賢從羅崗華鹽蕭餘臨樓鄴棲吳錦驛溫雙壩蓮橋閻開紅麗歷蔭嶽廬瑤裡滄鎮侖鐵渾臺馬礄"
DIVISION_SUFFIXES = "省 市 区 县 旗".split()
LONG_DIVISION_SUFFIXES = "新區 新区 開發區 开发区 高新區 高新区 經濟區 经济区 工業區 工业区 保稅區 保税区 自治州 自治縣 自治县".split()
ROAD_SUFFIXES = "大道 路 街 巷 胡同 弄".split()
ADMIN_SUFFIXES = "省 自治區 自治区 市 區 区 縣 县 旗 鎮 镇 鄉 乡".split()
COMPONENT_SUFFIXES = [*ADMIN_SUFFIXES, *"大道 路 街 道 巷 弄 胡同 園 园 苑 村 大廈 大厦 大樓 大楼 廣場 广场 公寓 公館 公馆 別墅 别墅 酒店 飯店 饭店 賓館 宾馆 大院 號院 号院".split()]
UNITS = "號号弄院棟栋幢座樓楼層层室組组排期單单元"
PLACE_WORDS = "園 园 苑 小區 小区 社區 社区 大廈 大厦 SOHO 村 廣場 广场 樓 楼 棟 栋 座 單元 单元 室 號院 号院".split()
INDOOR = "會議室 会议室 辦公室 办公室 實驗室 实验室 休息室 接待室 展廳 展厅 市場部 市场部 财务部 財務部 人事部 技術部 技术部 前台".split()
TAIL_WORDS = (
    "開會 开会 碰面 見面 见面 參加 参加 辦理 办理 收件 前台 附近 今天 明天 後續 后续 請 请 聯絡 联络 聯繫 联系 謝謝 谢谢 窗口 取報告 取报告 取件 取回 領取 领取 諮詢 咨询 簽字 签字 面談 面谈 報到 报到 自提 提貨 提货"
).split()
NO_PLACE_INITIALS = "您你我他她它咱該该去到在往找請请幫帮給给把從从讓让叫是有沒没這这"
MEASURES = "點点時时分秒月日年週周折人位元塊块歲岁度次份件台輛辆場场成張张名個个萬万"
#: Words that lead to an address.
ANCHOR = r"到|去|在|前往|送往|(?:派送|寄送|[请請]寄|[邮郵]寄)至|家住|(?:住址|地址)[是為为]|地址(?=[一-鿿])(?![改填寫写為为是在])"

LONGEST, NAME_TAIL, SHORT_CODE, SHORT_NUMBER, BACK, LEVELS = 128, 4, 4, 2, 6, 3
_HAN, _WIDE_HAN = r"[一-鿿]", r"[㐀-鿿]"
_any = lambda words: "|".join(sorted(words, key=lambda w: (-len(w), w)))
#: What a text has that is worth a search, for Java's engine.
GUARD = r"[省市区區县縣旗镇鎮乡鄉路街道巷弄园園苑村厦廈场場寓馆館墅店院楼樓]|胡同"
_SEGMENT = re.compile(rf"(?:(?!的|{_any(TAIL_WORDS)})(?:{_WIDE_HAN}|[A-Za-z0-9]|[^\S\n\r]|[·・#－-])){{0,{LONGEST}}}")
_TOKEN = re.compile(r"(?P<gap>[\s·・#－-]+)|(?P<number>[0-9]+)|(?P<code>[A-Za-z]+)|(?P<han>[^\s·・#－A-Za-z0-9-]+)")
_NAMED = re.compile(rf"{_HAN}{{2,}}(?:{_any(COMPONENT_SUFFIXES)})")
_LEADING_UNITS = re.compile(f"[{UNITS}]+")
_SUFFIX = re.compile(f"(?={_any(LONG_DIVISION_SUFFIXES + DIVISION_SUFFIXES + ROAD_SUFFIXES)})")
_STARTING = [re.compile(_any(x)) for x in (LONG_DIVISION_SUFFIXES, DIVISION_SUFFIXES, ROAD_SUFFIXES)]
_ANCHORED = re.compile(rf"(?:{ANCHOR})\s*")


def both_scripts(names: list[str]) -> list[str]:
    """Names as given and in traditional characters."""
    table = str.maketrans(SIMPLIFIED, TRADITIONAL)
    return sorted({x for n in names for x in (n, n.translate(table), n.translate(table).replace("臺", "台"))})


_ADMIN = re.compile(rf"{_HAN}{{2,}}(?:{_any(ADMIN_SUFFIXES)})|{_any(both_scripts(CITIES))}")
_DISTRICT = re.compile(_any(both_scripts(DISTRICTS)))
_PLACE, _INDOOR = re.compile(_any(PLACE_WORDS)), re.compile(_any(INDOOR))
_ROAD, _NAMED_ROAD = re.compile("[路街巷弄道]|胡同"), re.compile(rf"{_HAN}{{2,}}(?:[路街巷弄道]|胡同)")


class Gazetteer:
    """Place names as a trie from their last character to their first."""

    def __init__(self, names: list[str]):
        self.root: dict = {}
        for name in names:
            node = self.root
            for c in reversed(name):
                node = node.setdefault(c, {})
            node[""] = len(name)

    def ending_at(self, text: str, end: int) -> int:
        """Length of the longest name that ends before ``end``, or 0."""
        node, at, best = self.root, end, 0
        while at > 0 and (node := node.get(text[at - 1])) is not None:
            at -= 1
            best = node.get("", best)
        return best

    def leftward(self, text: str, start: int) -> int:
        """``start`` moved over the names right before it, a district, a city and a province at most."""
        for _ in range(LEVELS):
            n = self.ending_at(text, start)
            if not n:
                break
            start -= n
        return start


KNOWN = Gazetteer(both_scripts([*PROVINCES, *CITIES, *DISTRICTS]))
_LONG = re.compile(f"(?={_any(both_scripts(LONG_DIVISIONS))})")


def _is_han(c: str) -> bool:
    return "㐀" <= c <= "鿿"


def seeds(text: str, known: Gazetteer = KNOWN) -> set[int]:
    """Where an address may start: at whole division names, and some characters before each suffix.

    Two characters before it if no more is known; further to the left if the name then joins a known one at the start of its run.
    """
    out = {m.start() for m in _LONG.finditer(text)}
    for at in {m.start() for suffix in _STARTING for m in suffix.finditer(text)}:
        ways = []
        for start in range(at - 2, max(-1, at - BACK - 1), -1):
            if not _is_han(text[start]):
                break
            ways.append((known.leftward(text, start), start))
        joined = [x for x, start in ways if x < start and not (x and _is_han(text[x - 1]))]
        if ways:
            out.add(joined[0] if joined else ways[0][0])
    return out


def chain(segment: str) -> tuple[int, int] | None:
    """Start and end of the components in a segment, or None."""
    first = end = undo = None
    follows, before, spaced = False, "", False  # whether the last token belongs to the chain, its sort, and a blank after it
    for m in _TOKEN.finditer(segment):
        sort, text, at = m.lastgroup, m[0], m.start()
        if sort == "gap":
            spaced = any(map(str.isspace, text))
            continue
        blank, spaced = spaced, False
        if sort == "han":
            unit = _LEADING_UNITS.match(text) if first is not None and before in ("number", "code") else None
            skip = unit.end() if unit else 0
            if unit:
                end, undo = at + skip, None
            named = _NAMED.search(text, skip)
            if named:
                if first is None and text[named.start()] not in NO_PLACE_INITIALS:
                    first = at + named.start()
                if first is not None:
                    end, undo = at + min(len(text), named.end() + NAME_TAIL), None
            follows = first is not None and bool(named or unit)
        elif first is not None and follows and (len(text) <= SHORT_CODE if sort == "code" else not (before == "number" and blank)):
            undo = end if sort == "number" and len(text) <= SHORT_NUMBER else None
            end = m.end()
        else:
            follows = False
        before = sort
    if first is None:
        return None
    if undo is not None and segment[end:].lstrip()[:1] in set(MEASURES):  # "8 点" is no number of a house
        end = undo
    return first, first + len(segment[first:end].rstrip())


def enough(value: str, seeded: bool) -> bool:
    """Whether the parts make an address; one found by its own structure needs a number in digits."""
    digits = any("0" <= c <= "9" for c in value)
    road, number = bool(_ROAD.search(value)), digits or any(c in "一二三四五六七八九十百" for c in value)
    if seeded and not digits or not road and _INDOOR.search(value):
        return False
    if digits and _NAMED_ROAD.search(value):
        return True
    admin, place = bool(_ADMIN.search(value)), bool(_PLACE.search(value))
    return number and (road and (admin or place) or place and (admin or bool(_DISTRICT.search(value))))


def addresses(text: str, code: list[tuple[int, int]], known: Gazetteer = KNOWN) -> list[tuple[int, int]]:
    """Spans of addresses outside ``code``, of nested ones the widest; in order."""
    inside = lambda a, b: any(lo < b and a < hi for lo, hi in code)
    found = set()
    starts = {(m.end(), False) for m in _ANCHORED.finditer(text)} | {(s, True) for s in seeds(text, known)}
    for start, seeded in starts:
        if start >= len(text) or inside(start, start + 1):
            continue
        span = chain(_SEGMENT.match(text, start)[0])
        if span and span[0] < span[1]:
            lo, hi = start + span[0], start + span[1]
            if not inside(lo, hi) and enough(text[lo:hi], seeded):
                found.add((lo, hi))
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(found, key=lambda s: (s[0], -s[1])):
        if not out or hi > out[-1][1]:
            out.append((lo, hi))
    return out
