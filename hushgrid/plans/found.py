"""SQL of the spans that documents hold, in plain functions of the checking engine: mail addresses, IPv4 addresses, cards and labelled
secrets in quotes, the kinds that occur in the given texts. It shares nothing with the rules but what they look for.
"""

from __future__ import annotations

EMAIL = r"[A-Za-z0-9.!#$%&''*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_SECRET = r"""(?i)(?:^|[^A-Za-z0-9_])["'']?(?:token|password|passwd|pwd|passcode|secret|api[_-]?key|credential|bearer)["'']?[ \t]{0,8}[:=][ \t]{0,8}["''][^"''\\\n]+["'']"""


def _runs(name: str, pattern: str, table: str, keys: str) -> str:
    """Matches of a pattern with their places."""
    return f"""{name}0 as (select {keys}, text, regexp_extract_all(text, '{pattern}') as m, string_split_regex(text, '{pattern}') as g from {table}),
      {name}1 as (select {keys}, text, m, g, unnest(range(1, len(m) + 1)) as i from {name}0),
      {name} as (select {keys}, text, m[i] as raw, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::int as pos from {name}1)"""


def found_sql(table: str = "documents", keys: str = "doc_id") -> str:
    """CTEs up to ``found``: keys, kind, decision, source, start_, end_, raw, normalized."""
    digits = "list_reverse(list_transform(string_split(regexp_replace(raw, '[ -]', '', 'g'), ''), lambda x: x::int))"
    luhn = f"list_sum(list_transform({digits}, lambda d, i: case when i % 2 = 1 then d when d > 4 then d * 2 - 9 else d * 2 end)) % 10 = 0"
    names = [k.strip() for k in keys.split(",")]
    s_keys, joined = ", ".join(f"s.{k}" for k in names), " and ".join(f"s.{k} = d.{k}" for k in names)
    return f"""{_runs("mails", EMAIL, table, keys)}, {_runs("dotted", "[0-9.]+", table, keys)}, {_runs("digits", "[0-9](?:[ -]?[0-9])*", table, keys)}, {_runs("solid", "[0-9]+", table, keys)}, {_runs("secrets", _SECRET, table, keys)},
      cards as (select {keys}, text, raw, pos from digits where length(regexp_replace(raw, '[ -]', '', 'g')) between 13 and 19
        union all select {s_keys}, s.text, s.raw, s.pos from solid s join digits d on {joined} and d.pos <= s.pos and s.pos + length(s.raw) <= d.pos + length(d.raw)
          where length(s.raw) between 13 and 19 and length(regexp_replace(d.raw, '[ -]', '', 'g')) > 19),
      secret as (select {keys}, 'credential' as kind, 'block' as decision, 'context' as source, (pos + length(raw) - 1 - length(v))::int as start_, (pos + length(raw) - 1)::int as end_, v as raw, v as normalized
        from (select *, regexp_extract(raw, '["'']([^"'']+)["'']$', 1) as v from secrets)),
      other as (
        select {keys}, 'email' as kind, 'replace' as decision, 'structured' as source, pos as start_, (pos + length(raw))::int as end_, raw, lower(raw) as normalized from mails
        union all select {keys}, 'ipv4', 'replace', 'structured', pos, (pos + length(raw))::int, raw, raw from dotted where regexp_full_match(raw, '([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}')
          and list_max(list_transform(string_split(raw, '.'), lambda x: x::int)) <= 255 and string_split(raw, '.')[1]::int <> 127 and raw not in ('0.0.0.0', '255.255.255.255')
        union all select {keys}, 'bank_card', 'replace', null, pos, (pos + length(raw))::int, raw, regexp_replace(raw, '[ -]', '', 'g') from cards
          where substr(text, pos, 1) <> '-' and not regexp_matches(substr(text, pos + length(raw) + 1, 1), '[Xx-]') and {luhn}),
      found as (select * from secret union all select * from other o where not exists (select 1 from secret s where {" and ".join(f"s.{k} = o.{k}" for k in names)} and s.start_ < o.end_ and o.start_ < s.end_))"""


_OPEN = r"""(?i)(?:^|[^A-Za-z0-9_])["'']?(?:token|password|passwd|pwd|passcode|secret|api[_-]?key|credential|bearer)["'']?[ \t]{0,8}[:=][ \t]{0,8}[^\s"''`;][^\n\r;]*?[ \t]*(?:$|[\n\r;]|\.(?:\s|$))"""
_OPEN_PARTS = _OPEN.replace("(?:^|", "^((?:^|", 1).replace("[^\\s", ")([^\\s", 1).replace("*?[ ", "*?)[ ", 1)
_CUES = "(?i)qq|user|login|alias|handle|telegram|tg|discord"
_TECHNICAL = "(?i)pipeline|rollout|audit|fixture|trace|cache|tenant|stage|gateway|search[-_ ]?index|topic[-_ ]?consumer"
_KEYS = "(?i)api|access|refresh|bearer|secret|token|password|passwd|key|version|commit|branch|build|port|order|pipeline|rollout|audit|fixture|sample|model[-_ ]?card"
_COMMON = (
    "account address admin alias branch channel client contact demo destination email english example follow handle handoff login message name owner password phone project ready reply sample server service source status "
    "target text token user username version"
).split()


def every_sql() -> str:
    """CTEs up to ``every``, the spans of documents of all kinds that occur in the given texts: those of ``found_sql``, secrets without quotes, access keys, cards
    told by their first digits and handles beside words that speak of accounts; what overlaps a stronger span is left out."""
    free = lambda name, *others: " and ".join(f"not exists (select 1 from {o} o where o.doc_id = {name}.doc_id and o.start_ < {name}.end_ and {name}.start_ < o.end_)" for o in others)
    around = lambda n: f"substr(text, greatest(start_ - {n}, 0) + 1, end_ + {n} - greatest(start_ - {n}, 0))"
    shape = "doc_id, kind, decision, policy, inferred, start_, end_"
    luhn = lambda x: f"list_sum(list_transform(list_reverse(list_transform(string_split({x}, ''), lambda c: c::int)), lambda d, i: case when i % 2 = 1 then d when d > 4 then d * 2 - 9 else d * 2 end)) % 10 = 0"
    return f"""{found_sql()}, {_runs("open_", _OPEN, "(select * from documents where regexp_matches(text, '[:=]'))", "doc_id")}, {_runs("words_", "[A-Za-z0-9_]+", "(select * from documents where contains(text, 'AKIA'))", "doc_id")},
      {_runs("tokens_", "@?[A-Za-z0-9._-]+", f"(select * from documents where regexp_matches(text, '{_CUES}'))", "doc_id")},
      keys_ as (select doc_id, 'api_key' as kind, 'block' as decision, null as policy, false as inferred, pos as start_, (pos + length(raw))::int as end_ from words_ where regexp_full_match(raw, 'AKIA[0-9A-Z]{{16}}')),
      told_ as (select doc_id, (pos + length(regexp_extract(raw, '{_OPEN_PARTS}', 1)))::int as start_, regexp_extract(raw, '{_OPEN_PARTS}', 2) as v from open_),
      secrets_ as (select doc_id, start_, (start_ + length(v))::int as end_ from told_ where v <> '' and v not like '[[%' union all select doc_id, start_, end_ from secret),
      blocks_ as (select doc_id, 'credential' as kind, 'block' as decision, null as policy, false as inferred, start_, end_ from secrets_ s
        where {free("s", "keys_")} and not exists (select 1 from secrets_ o where o.doc_id = s.doc_id and o.start_ < s.start_ and s.start_ < o.end_)),
      asked_ as (select doc_id, 'bank_card' as kind, 'replace' as decision, 'confirm' as policy, false as inferred, pos as start_, (pos + length(raw))::int as end_ from solid
        where regexp_full_match(raw, '62[0-9]{{14}}') and substr(text, pos, 1) <> '-' and substr(text, pos + length(raw) + 1, 1) <> '-'),
      first_ as (select * from keys_ union all select * from blocks_ union all select * from asked_ where {free("asked_", "keys_", "blocks_")}),
      plain_ as (select doc_id, kind, decision, null as policy, false as inferred, start_, end_ from other where kind <> 'bank_card' and {free("other", "first_")}),
      cards_ as (select c.doc_id, c.start_, c.end_, c.raw, coalesce(max(case when p.start_ <= c.start_ then p.end_ end), c.start_) as low, coalesce(min(case when p.start_ > c.start_ then p.start_ end), c.end_) as high
        from other c left join plain_ p on p.kind = 'ipv4' and p.doc_id = c.doc_id and p.start_ < c.end_ and c.start_ < p.end_ where c.kind = 'bank_card' and {free("c", "first_")} group by c.doc_id, c.start_, c.end_, c.raw),
      left_ as (select doc_id, start_, end_, low, high, rtrim(substr(raw, low - start_ + 1, high - low), ' -') as rest from cards_),
      own_ as (select doc_id, 'bank_card' as kind, 'replace' as decision, null as policy, false as inferred, (low + length(rest) - length(ltrim(rest, ' -')))::int as start_, (low + length(rest))::int as end_ from left_
        where (low = start_ and high = end_) or (length(regexp_replace(rest, '[ -]', '', 'g')) between 13 and 19 and {luhn("regexp_replace(rest, '[ -]', '', 'g')")})),
      sure_ as (select * from first_ union all select * from plain_ union all select * from own_),
      named_ as (select doc_id, text, pos as start_, (pos + length(raw))::int as end_, ltrim(raw, '@') as v from tokens_ where regexp_full_match(ltrim(raw, '@'), '[A-Za-z][A-Za-z0-9._-]{{3,63}}')),
      handles_ as (select doc_id, 'account' as kind, 'replace' as decision, 'confirm' as policy, true as inferred, start_, end_ from named_ n
        where length(regexp_replace(v, '[._-]', '', 'g')) >= 4 and not regexp_full_match(lower(regexp_replace(v, '[._-]', '', 'g')), '[eg][0-9]{{8}}') and lower(v) not in ({", ".join(repr(w) for w in _COMMON)})
          and regexp_matches({around(32)}, '{_CUES}') and not regexp_matches({around(32)}, '{_TECHNICAL}') and not regexp_matches({around(40)}, '{_KEYS}') and {free("n", "sure_")}),
      every as (select {shape} from sure_ union all select {shape} from handles_)"""
