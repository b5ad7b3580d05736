"""Line dedup by content-defined chunks of lines (operator 4), native.

Each line is hashed; a rolling hash over the last ``ROLL`` line hashes ends a chunk where it is 0 modulo
``MODULUS``, so boundaries depend on the lines around them alone and shift with inserted text. A line of
``MIN_WORDS`` words or more is a chunk of its own, whatever stands around it. Chunks of at least ``MIN_LINES``
lines, or ``MIN_WORDS`` words, that occur again anywhere are removed but for the first occurrence (smallest id,
text digest, place). A 64-bit hash finds the chunks that may repeat; only those are compared, by grouping on
their bytes. A removed chunk then grows: lines before it that equal, byte by byte, those before the first occurrence
go as well, over the chunk before and past chunks of a single line over up to ``REACH``, and so do lines after it. So a
passage goes whole although its first and last lines share chunks with their neighbours. Within one document, growth
stops at chunks that are first occurrences; otherwise it is from a later document to an earlier one, so each line stays
somewhere.

Rows with the same id and text are one document. A null text stays null, an empty one empty; a null id is
the smallest id; very long texts count whole. Of equal chunks in one text the first stays. An empty table gives
no rows. A column named lines_before or lines_removed gets an underscore.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, materialize

ROLL, BASE, PRIME, MODULUS = 2, 31, 1_000_003, 3
MIN_LINES, MIN_WORDS = 2, 50
#: Repeated hashes (8 bytes each), and bytes of the documents' marks, up to which they are sent to every task.
BROADCAST_HASHES, BROADCAST_BYTES = 2_000_000, 64 << 20

_WORD = "[^\\\\x20\\\\x09-\\\\x0D]+"
_LINE_HASH = "cast(conv(substring(md5(cast(l as binary)), 1, 8), 16, 10) as bigint)"
#: A line shorter than so many bytes can't have MIN_WORDS words, so they aren't counted.
_LONG = f"octet_length(l) >= {2 * MIN_WORDS - 1} and regexp_count(l, '{_WORD}') >= {MIN_WORDS}"
_ENDS = (
    f"filter(sequence(0, size(h) - 1), i -> i = size(h) - 1 or b[i] or b[i + 1] or (h[i] + {BASE} * if(i = 0, 0, h[i - 1])) % {PRIME} % {MODULUS} = 0)"
)
_SLICES = "transform(ends, (e, j) -> slice(lines, if(j = 0, 0, ends[j - 1] + 1) + 1, e - if(j = 0, 0, ends[j - 1] + 1) + 1))"
#: Chunks over which a removed one may grow, where all but the last are single lines.
REACH = 6
_PAST = "coalesce(nullif(array_position(transform(sequence(1, {n}), k -> size(get(chunks, {at})) > 1), true), 0), {n})"
_BEFORE, _AFTER = _PAST.format(n=f"least(i, {REACH})", at="i - k"), _PAST.format(n=f"least(size(chunks) - 1 - i, {REACH})", at="i + k")
#: Whether a chunk counts; one line alone must be long.
_TELLING = f"(size(c) >= {MIN_LINES} or exists(c, l -> {_LONG}))"
#: Each such chunk with its first line's number, and the lines before and after it over which it may grow.
_BESIDE = f"""transform(filter(transform(chunks, (c, i) -> named_struct('c', c, 'i', i)), x -> {_TELLING.replace("(c)", "(x.c)").replace("exists(c,", "exists(x.c,")}), x ->
    transform(array(x.i), i -> named_struct('c', x.c, 'lo', if(i = 0, 0, ends[i - 1] + 1),
    'before', if(i = 0, array(), flatten(slice(chunks, i + 1 - cast({_BEFORE} as int), cast({_BEFORE} as int)))),
    'after', if(i = size(chunks) - 1, array(), flatten(slice(chunks, i + 2, cast({_AFTER} as int))))))[0])"""
#: Lines that stay. marks: lo and hi of each repeated chunk, whether it is a later one, of another document, and by how many lines (tail, head) it has grown.
_KEPT = """filter(split(coalesce(`{text}`, ''), '\\n', -1), (l, i) -> not exists(marks, m -> m.later and m.lo - m.tail <= i and i <= m.hi + m.head
    and (m.other or not exists(marks, f -> not f.later and f.lo <= i and i <= f.hi))))"""


def _bound(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with ``name`` bound once: a column used in a lambda would be computed for each element."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _chunks(text: str, body: str = "chunks") -> str:
    """SQL of ``body`` over the chunks (arrays of lines) of a text."""
    lines = f"split(coalesce(`{text}`, ''), '\\n', -1)"
    ends = _bound("h", f"transform(lines, l -> {_LINE_HASH})", _bound("b", f"transform(lines, l -> {_LONG})", _ENDS.replace("b[i + 1]", "coalesce(get(b, i + 1), false)")))
    return _bound("lines", lines, _bound("ends", ends, _SLICES if body == "chunks" else _bound("chunks", _SLICES, body)))


def _equal(a: str, b: str, last: bool) -> str:
    """SQL of how many lines two arrays share at their end (or start)."""
    at = "-i" if last else "i"
    return _bound("n", f"least(size({a}), size({b}))", f"if(n = 0, 0, {_bound('p', f'array_position(transform(sequence(1, n), i -> element_at({a}, {at}) = element_at({b}, {at})), false)', 'if(p = 0, n, cast(p as int) - 1)')})")


def removals(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """_id, _digest and marks (lo, hi, other, later, tail, head) of the repeated chunks of each document that loses some."""
    keys = [F.col(f"`{id_col}`").alias("_id"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")).alias("_digest")]

    def hashed(each: DataFrame) -> DataFrame:
        return each.withColumn("body", F.concat_ws("\n", "c")).withColumn("h", F.xxhash64("body"))

    hashes = hashed(docs.select(F.explode(F.expr(_chunks(text, f"filter(chunks, c -> {_TELLING})"))).alias("c")))
    again = materialize(hashes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "again")
    small = F.broadcast(again) if again.count() <= BROADCAST_HASHES else again
    each = docs.select(*keys, F.explode(F.expr(_chunks(text, _BESIDE))).alias("x")).select("_id", "_digest", "x.*").withColumn("hi", F.col("lo") + F.size("c") - 1)
    maybe = materialize(hashed(each).join(small, "h", "left_semi").drop("c"), "maybe")
    # read anew, so that the rows of a common chunk can be split in the join
    first = materialize(maybe.groupBy("h", "body").agg(F.min(F.struct("_id", "_digest", "lo", "before", "after")).alias("first")).select("h", "body", "first.*"), "first")
    named = first.select("h", "body", F.struct("_id", "_digest", "lo").alias("at"), F.col("before").alias("fb"), F.col("after").alias("fa"))
    later = ~F.struct("_id", "_digest", "lo").eqNullSafe(F.col("at"))
    other = ~(F.col("_id").eqNullSafe(F.col("at._id")) & (F.col("_digest") == F.col("at._digest")))
    mark = F.struct("lo", "hi", other.alias("other"), later.alias("later"), F.when(later, F.expr(_equal("before", "fb", True))).otherwise(0).alias("tail"), F.when(later, F.expr(_equal("after", "fa", False))).otherwise(0).alias("head"))
    marked = maybe.join(named, ["h", "body"]).select("_id", "_digest", mark.alias("mark"))
    return marked.groupBy("_id", "_digest").agg(F.collect_set("mark").alias("marks")).where(F.exists("marks", lambda m: m["later"]))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` without its repeated chunks, and ``lines_before`` and ``lines_removed``."""
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    gone = materialize(removals(docs.select(F.col(f"`{id_col}`").alias("_i"), F.col(f"`{text}`").alias("_t")), "_i", "_t"), "gone").withColumnsRenamed({"_id": "_gid", "_digest": "_gdigest"})
    size = gone.agg(F.coalesce(F.sum(F.size("marks") * 32 + 80), F.lit(0))).first()[0]
    small = F.broadcast(gone) if size <= BROADCAST_BYTES else gone
    digest = F.md5(F.coalesce(F.col(own[text]), F.lit("")).cast("binary"))
    joined = rows.join(small, F.col(own[id_col]).eqNullSafe(F.col("_gid")) & (digest == F.col("_gdigest")), "left")
    # texts without marks aren't cut into lines again
    kept = joined.withColumn("_kept", F.expr(f"if(marks is null, null, {_KEPT.format(text=own[text])})"))
    after = F.when(F.col("marks").isNull(), F.col(own[text])).otherwise(F.concat_ws("\n", "_kept"))
    names = free_names(docs.columns, ["lines_before", "lines_removed"])
    cols = [(after if c == text else F.col(n)).alias(k) for k, (c, n) in zip(names, own.items())]
    before = F.size(F.split(F.coalesce(F.col(own[text]), F.lit("")), "\n", -1))
    return kept.select(*cols, before.alias("lines_before"), F.when(F.col("marks").isNull(), 0).otherwise(before - F.size("_kept")).alias("lines_removed"))


def oracle_sql() -> str:
    """Lines and digests in DuckDB, for ids without nulls."""
    line_hash = "('0x' || substr(md5(l), 1, 8))::bigint"
    words = "len(regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+'))"
    equal = lambda a, b, at: f"coalesce(list_position(list_transform(range(1, least(len({a}), len({b})) + 1), lambda i: {a}[{at}] = {b}[{at}]), false) - 1, least(len({a}), len({b})))"
    return f"""
    with d as (select distinct doc_id, text, md5(text) as digest, string_split(text, chr(10)) as lines from documents),
      h as (select *, list_transform(lines, lambda l: {line_hash}) as h, list_transform(lines, lambda l: {words.format("l")} >= {MIN_WORDS}) as b from d),
      e as (select *, list_filter(range(1, len(h) + 1), lambda i: i = len(h) or b[i] or b[i + 1] or (h[i] + {BASE} * case when i = 1 then 0 else h[i - 1] end) % {PRIME} % {MODULUS} = 0) as ends from h),
      c as (select doc_id, digest, lines, pos, case when pos = 1 then 1 else ends[pos - 1] + 1 end as lo, ends[pos] as hi
            from (select *, unnest(range(1, len(ends) + 1)) as pos from e)),
      b as (select doc_id, digest, pos, lo, hi, lines[lo:hi] as ls, array_to_string(lines[lo:hi], chr(10)) as body from c),
      n as (select *, coalesce(list(ls) over (w rows between {REACH} preceding and 1 preceding), []) as bs, coalesce(list(ls) over (w rows between 1 following and {REACH} following), []) as ns from b window w as (partition by doc_id, digest order by pos)),
      t as (select doc_id, digest, pos, lo, hi, ls, body, len(ls) >= {MIN_LINES} or {words.format("body")} >= {MIN_WORDS} as telling,
            flatten(bs[len(bs) + 1 - coalesce(nullif(list_position(list_reverse(list_transform(bs, lambda x: len(x) > 1)), true), 0), len(bs)):]) as before,
            flatten(ns[:coalesce(nullif(list_position(list_transform(ns, lambda x: len(x) > 1), true), 0), len(ns))]) as after from n),
      r as (select *, telling and count(*) over (partition by body, telling) > 1 as again, telling and row_number() over w > 1 as later, first_value(before) over w as fb, first_value(after) over w as fa, first_value(doc_id) over w <> doc_id or first_value(digest) over w <> digest as other
            from t window w as (partition by body, telling order by doc_id, digest, pos)),
      g as (select *, case when later then {equal("before", "fb", "-i")} else 0 end as tail, case when later then {equal("after", "fa", "i")} else 0 end as head from r),
      k as (select *, coalesce(list((lo - tail, hi + head, other)) filter (where later) over (partition by doc_id, digest), []) as gone from g),
      s as (select *, case when later then [] else list_filter(ls, lambda l, i: len(list_filter(gone, lambda z: z[1] <= lo + i - 1 and lo + i - 1 <= z[2] and (z[3] or not again))) = 0) end as kept from k),
      a as (select doc_id, digest, array_to_string(flatten(list(kept order by pos)), chr(10)) as after, sum(len(ls)) as lines_before, sum(len(ls) - len(kept)) as lines_removed from s group by all)
    select documents.doc_id, lines_before::int as lines_before, lines_removed::int as lines_removed, md5(coalesce(after, '')) as after_md5
    from documents join a on documents.doc_id = a.doc_id and md5(documents.text) = a.digest"""
