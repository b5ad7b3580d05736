"""Span detection by native regular expressions: one projection over a text; Python only sees texts whose view differs in length or that hold code."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import kinds
from ..functions import text as tx
from ..functions import places, unicode, validators
from ..functions.patterns import LONG_RUN, RULES, Rule

#: What stands for the raw value of a secret that is too long to keep.
OMITTED = "<已省略的长凭证>"


#: Matches whose places are added up one after another; longer lists are cut into blocks of as many.
_BLOCK = 128
_SLICE = f"slice(lens, c * {_BLOCK} + 1, {_BLOCK})"
#: SQL of the (rule, start, end, raw) of all ``_hits`` (rule, m: matches, g: gaps between them, v: values that end them, or null).
_PLACES = f"""flatten(transform(_hits, h -> transform(array(transform(sequence(0, size(h.m) - 1), i -> length(h.g[i]) + length(h.m[i]))), lens ->
    transform(array(sequence(0, (size(lens) - 1) div {_BLOCK})), blocks ->
    transform(array(aggregate(blocks, array(0), (acc, c) -> array_append(acc, element_at(acc, -1) + aggregate({_SLICE}, 0, (a, x) -> a + x)))), offs ->
    transform(array(flatten(transform(blocks, c -> slice(aggregate({_SLICE}, array(offs[c]), (acc, x) -> array_append(acc, element_at(acc, -1) + x)), 2, {_BLOCK})))), ends ->
    transform(array(coalesce(h.v, h.m)), v -> transform(v, (x, i) -> named_struct('rule', h.rule, 'start', ends[i] - length(x), 'end', ends[i], 'raw', x)))[0])[0])[0])[0])[0]))"""


#: Stands around matches in a text that is cut there: a code point that no text should hold; one that does is cut by the pattern itself.
_CUT = "\uffff"


def _hit(n: int, r: Rule) -> Column:
    """The matches of a rule with the gaps between them, or null.

    A pass marks the matches (and values) and the text is cut at the marks: to split by the pattern would compile it for each row.
    """
    text, p, width = F.col("_t"), F.lit(r.pattern), 3 if r.value else 2
    none = F.lit(None).cast("array<string>")
    of = lambda m, g, v: F.struct(F.lit(n).alias("rule"), m.alias("m"), g.alias("g"), v.alias("v"))
    slow = of(F.regexp_extract_all(text, p, F.lit(0)), F.split(text, r.pattern, -1), F.regexp_extract_all(text, p, F.lit(1)) if r.value else none)
    cut = F.split(F.regexp_replace(text, r.pattern, f"{_CUT}$0{_CUT}" + (f"$1{_CUT}" if r.value else "")), _CUT, -1)
    every = lambda parts, k: F.filter(parts, lambda x, i: i % width == k)
    fast = F.get(F.transform(F.array(cut), lambda parts: of(every(parts, 1), every(parts, 0), every(parts, 2) if r.value else none)), F.lit(0))
    found = F.when(text.contains(_CUT), slow).otherwise(fast)
    if not (r.guard or r.needs):
        return found
    first = F.col(f"_{r.needs}") if r.needs else F.lit(True)
    return F.when(first & (text.rlike(r.guard) if r.guard else F.lit(True)), found)


def _seen(df: DataFrame, keys: list[str], text: str, find: bool) -> DataFrame:
    """``keys`` with _t, the text that rules look at, and, where it isn't the source as it is, _src with the offsets, and _code; _placed if ``find``."""
    rows = df.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_s"))
    source = F.col("_s")
    foreign = F.octet_length(source) != F.length(source)
    odd = source.contains("`") | source.contains("~~~") | F.when(foreign, unicode.unusual(source).rlike(unicode.CHANGED)).otherwise(F.lit(False))
    wanted = odd | foreign & source.rlike(places.GUARD) if find else odd
    plain = unicode.same_length_view(source)
    # Python gets the texts that need it, and nulls for the others
    seen = rows.select(*keys, "_s", odd.alias("_odd"), wanted.alias("_wanted")).select("*", unicode.view_and_code(F.when(F.col("_wanted"), source), F.col("_odd"), places.addresses if find else None).alias("_v"))
    view = F.when(F.col("_odd"), F.col("_v.text")).otherwise(plain)
    return seen.select(*keys, "_s", "_odd", "_v", view.alias("_t")).select(
        *keys, "_t", F.when(F.col("_odd") | (F.col("_t") != source), source).alias("_src"), F.col("_v.starts").alias("_starts"), F.col("_v.ends").alias("_ends"), F.col("_v.code").alias("_code"), F.col("_v.found").alias("_placed"),
    )


def _around(s: Column, radius: int, after: int | None = None) -> Column:
    start = F.greatest(s["start"] - radius, F.lit(0))
    return F.substring(F.col("_t"), start + 1, s["end"] + (radius if after is None else after) - start)


def _passes(rules: tuple[Rule, ...], s: Column) -> Column:
    """The conditions of a span's rule on what stands around it."""
    ok = F.lit(True)
    ahead = lambda n: F.substring(F.col("_t"), F.greatest(s["start"] - n, F.lit(0)) + 1, F.least(s["start"], F.lit(n)))
    for n, r in enumerate(rules):
        own = []
        if r.near:
            own.append(_around(s, r.radius, r.after).rlike(r.near))
        if r.avoid:
            own.append(~_around(s, r.radius, r.after).rlike(r.avoid))
        if r.before:
            own.append(~ahead(40).rlike(r.before))
        if own:
            ok &= (s["rule"] != n) | reduce(and_, own)
    of = lambda has: [n for n, r in enumerate(rules) if has(r)]
    plain, outside = of(lambda r: r.plain), of(lambda r: r.plain or r.outside_code)
    if outside:
        code = F.coalesce(F.exists("_code", lambda c: (c["start"] < s["end"]) & (s["start"] < c["end"])), F.lit(False))
        ok &= ~s["rule"].isin(*outside) | ~code
    if plain:
        technical = validators.technical_context(ahead(32), F.substring(F.col("_t"), s["end"] + 1, F.lit(32)))
        ok &= ~s["rule"].isin(*plain) | ~technical
    # 14 places on either side hold the seven digits that a run needs beyond 13, and are too few for a run of their own
    beside = lambda: _around(s, 14).rlike(LONG_RUN)
    gates = {
        "account": validators.account_in_context, "handle": lambda v, a, c: validators.handle_in_context(v, a, c, _around(s, 40)),
        "alone": lambda v, a, c: ~beside(), "beside_numbers": lambda v, a, c: beside(),
    }
    for gate, test in gates.items():
        gated = of(lambda r, g=gate: r.gate == g)
        if gated:
            ok &= ~s["rule"].isin(*gated) | test(s["raw"], ahead(12), _around(s, 32))
    return ok


#: Spans on either side in which an overlapping one may stand: none of a yielding rule's kind is that long.
_NEIGHBOURS = 64


def _settling(n: int, same: list[int]):
    """Takes the spans of rule ``n`` out that overlap a kept one of the rules ``same``."""

    def settle(every: Column) -> Column:
        beside = lambda i: F.slice(every, F.greatest(i - _NEIGHBOURS, F.lit(0)) + 1, F.lit(2 * _NEIGHBOURS + 1))
        hit = lambda s, i: F.exists(beside(i), lambda o: o["rule"].isin(*same) & o["kept"] & (o["start"] < s["end"]) & (s["start"] < o["end"]))
        return F.transform(every, lambda s, i: F.when((s["rule"] == n) & hit(s, i), s.withField("kept", F.lit(False))).otherwise(s))

    return settle


def _placed_as(n: int):
    text = lambda p: F.substring(F.col("_t"), p["start"] + 1, p["end"] - p["start"])
    return lambda p: F.struct(F.lit(n).alias("rule"), p["start"].alias("start"), p["end"].alias("end"), text(p).alias("raw"))


def _yielding(rules: tuple[Rule, ...]) -> Column:
    """``_found`` without spans of yielding rules that overlap an earlier span of their kind: rule by rule, each only beside its neighbours."""
    kinds_ = {r.kind for r in rules if r.yields}
    kind = [n for n, r in enumerate(rules) if r.kind in kinds_]
    own = F.array_sort(F.transform(F.filter("_found", lambda s: s["rule"].isin(*kind)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rule"].alias("rule"), s["raw"].alias("raw"), F.lit(True).alias("kept"))))
    for n in kind:
        same = [k for k in kind if k < n and rules[k].kind == rules[n].kind]
        if rules[n].yields and same:
            own = F.get(F.transform(F.array(own), _settling(n, same)), F.lit(0))
    kept = F.transform(F.filter(own, lambda s: s["kept"]), lambda s: F.struct(s["rule"].alias("rule"), s["start"].alias("start"), s["end"].alias("end"), s["raw"].alias("raw")))
    yields = [n for n, r in enumerate(rules) if r.yields]
    return F.when(F.exists("_found", lambda s: s["rule"].isin(*yields)), F.concat(F.filter("_found", lambda s: ~s["rule"].isin(*kind)), kept)).otherwise(F.col("_found"))


@dataclass(frozen=True)
class _Columns:
    """What a rule table asks of a text, as expressions: made once for a table and session, as making them costs more than many a query."""

    flags: dict[str, Column]
    hits: Column
    found: tuple[Column, ...]
    spans: Column
    checked: Column
    kind: Column
    decision: Column
    policy: Column
    source: Column
    told: Column
    out: tuple[Column, ...]


@lru_cache(maxsize=256)
def _columns(own: tuple[Rule, ...], application: str) -> _Columns:
    """``application`` names the session whose expressions these are."""
    flags = {"han": r"[\x{4e00}-\x{9fff}]", "digit": "[0-9]", "mark": "[:：=是为叫]"}
    used = {r.needs for r in own}
    matched = [_hit(n, r) for n, r in enumerate(own) if not r.finder]
    hits = F.filter(F.array_compact(F.array(*matched)), lambda h: F.size(h["m"]) > 0) if matched else F.array().cast("array<struct<rule:int,m:array<string>,g:array<string>,v:array<string>>>")
    found = [F.expr(_PLACES)]
    for n in (n for n, r in enumerate(own) if r.finder):
        found.append(F.when(F.size("_placed") > 0, F.concat("_found", F.transform("_placed", _placed_as(n)))).otherwise(F.col("_found")))
    if any(r.near or r.avoid or r.before or r.plain or r.outside_code or r.gate for r in own):
        found.append(F.filter("_found", lambda s: _passes(own, s)))
    if any(r.yields for r in own):
        found.append(_yielding(own))

    def placed(s: Column) -> Column:
        start, end = F.coalesce(F.get("_starts", s["start"]), s["start"]), F.coalesce(F.get("_ends", s["end"] - 1), s["end"])
        raw = F.when(F.col("_src").isNull(), s["raw"]).otherwise(F.substring(F.col("_src"), start + 1, end - start))
        return F.struct(s["rule"].alias("rule"), start.alias("start"), end.alias("end"), raw.alias("raw"), s["raw"].alias("seen"))

    rule, checked = F.col("rule"), F.lit(True)
    for name, check in validators.BY_NAME.items():
        at = [n for n, r in enumerate(own) if r.check == name]
        if at:
            checked &= ~rule.isin(*at) | check(F.col("seen"))
    told = ~(F.col("kind").isin("person_name", "address", "passport", "license_plate", "labeled_identifier", "china_id") & validators.placeholder_value(F.col("seen")))
    bounded = [n for n, r in enumerate(own) if r.longest]
    long = rule.isin(*bounded) & (F.length("seen") > kinds.MAX_CREDENTIAL) if bounded else F.lit(False)
    digest = F.concat(F.lit("credential_too_long:"), F.length("seen").cast("string"), F.lit("-"), F.left(F.sha2("seen", 256), F.lit(16)))
    out = (
        (rule * 100_000 + F.col("start")).alias("seq"), F.col("kind"), F.col("decision"), F.col("policy"), F.col("source"), F.col("start"), F.col("end"), F.when(long, OMITTED).otherwise(F.col("raw")).alias("raw"),
        F.when(long, digest).otherwise(tx.canonical(F.col("kind"), F.col("seen"))).alias("normalized"), F.when(long, "credential_too_long").alias("warning"),
    )
    return _Columns(
        {f"_{n}": F.col("_t").rlike(c) for n, c in flags.items() if n in used}, hits, tuple(found), F.explode(F.transform("_found", placed)).alias("s"), checked, _case([r.kind for r in own]),
        _case(["replace" if r.decision == "confirm" else r.decision for r in own]), _case(["confirm" if r.decision == "confirm" else None for r in own]), _case([r.source for r in own]), told, out,
    )


def detect(df: DataFrame, keys: list[str], text: str, rules: tuple[Rule, ...] = RULES, terms: list[str] | None = None) -> DataFrame:
    """Candidates of every rule, in emission order: ``keys``, seq, kind, decision, policy, source, start, end, raw, normalized, warning.

    Rules look at the normalized view; offsets count code points of the source, from 0, end exclusive. ``terms`` are
    literal custom terms, longest first, normalized alike. A null text has no candidates. A credential over its kind's
    length is one span of a placeholder, with a warning; its normalized form is its length and a digest.
    """
    literal = sorted({unicode.view_of(t.strip())[0] for t in terms or [] if t.strip()}, key=lambda t: (-len(t), t))
    own = (*rules, *(Rule("custom_term", "\\Q" + t.replace("\\E", "\\E\\\\E\\Q") + "\\E") for t in literal))
    c = _columns(own, df.sparkSession.sparkContext.applicationId)
    seen = _seen(df, keys, text, any(r.finder for r in own))
    listed = seen.select("*", *[v.alias(n) for n, v in c.flags.items()]).select(*keys, "_t", "_src", "_starts", "_ends", "_code", "_placed", c.hits.alias("_hits"))
    for step in c.found:
        listed = listed.withColumn("_found", step)
    each = listed.select(*keys, c.spans).select(*keys, "s.*")
    named = each.where(c.checked).select("*", c.kind.alias("kind"), c.decision.alias("decision"), c.policy.alias("policy"), c.source.alias("source"))
    return named.where(c.told).select(*keys, *c.out)


def _case(values: list[str | None]) -> Column:
    listed = ", ".join("null" if v is None else f"'{v}'" for v in values)
    return F.expr(f"element_at(cast(array({listed}) as array<string>), rule + 1)")
