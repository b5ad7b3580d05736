"""Benchmark decontamination by template canonicalisation (operator 5), native.

Words become templates: numbers, names (a capital inside a sentence) and units after a number turn into
typed placeholders, other words are lower-cased without punctuation. Windows of five template words are
hash-joined with those of the benchmark. Along one alignment (place in the text less place in the item)
each slot value of the item must stand for one value of the text; alignments that contradict themselves
don't count. A text that holds at least 0.8 of an item's windows is contaminated by it, whether the
values are the item's own or new ones.

Windows with over two placeholders say too little as templates: they are matched by their literal values,
and count where the telling windows alone fall short, or are under half of the item's windows: a few words of
a dense item make no match. Items without a window (null, empty or under
five words) match nothing; null and empty texts match nothing, very long ones are searched whole. Repeated
rows are each reported; a null id is an id. A key named as an output column gets an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, materialize

WINDOW = 5
COVERAGE = 0.8
#: Benchmark windows up to which they are sent to every task (about 100 bytes each).
BROADCAST_WINDOWS = 300_000
UNITS = (
    "mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "min", "h", "hours", "minutes", "seconds", "days", "weeks", "months",
    "years", "percent", "dollars", "euros", "cents", "miles", "feet", "inches", "pounds", "meters", "kilometers", "grams", "kilograms", "liters",
)


_WORDS = [f"w{k}" for k in range(WINDOW)]
NUM, NAME, UNIT = "\x01", "\x02", "\x03"
_PUNCTUATION = '.,;:!?"()[]'


def words(text: Column) -> Column:
    """The words of a text; a placeholder is its mark followed by the value."""
    plain = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), NUM + NAME + UNIT, ""), r"[\x20\x09-\x0D]+", " "))
    named = F.regexp_replace(plain, r"(?<=[^.!?:] )(?![^ ]*[0-9])(?=[^ ]*\p{Lu})[^ ]+", NAME + "$0")
    counted = F.regexp_replace(named, r"(?<![^ ])[^ ]*[0-9][^ ]*", NUM + "$0")
    measured = F.regexp_replace(counted, rf"({NUM}[^ ]+ )({'|'.join(UNITS)})(?=[ .,;:!?]|$)", f"$1{UNIT}$2")
    marked = F.when(plain.rlike("[0-9]"), measured).otherwise(named)
    return F.split(F.translate(F.lower(marked), _PUNCTUATION, ""), " ")


def windows(df: DataFrame, keys: list[str], text: Column, inside: bool = False) -> DataFrame:
    """``keys`` with pos, template (hash), dense (over two placeholders, kept by its literal values), first and slots of every window.

    An item's first word is a literal, as it starts a text. ``inside``: windows that start with a name or unit
    are also given with that word as a literal (first), for items that start there.
    """
    tokens = df.select(*keys, words(text).alias("t"))
    zipped = F.arrays_zip(*[F.slice("t", k + 1, F.size("t")).alias(f"w{k}") for k in range(WINDOW)])
    ws = [F.col(f"w{k}") for k in range(WINDOW)]
    each = tokens.select(*keys, F.posexplode(zipped).alias("pos", "w")).select(*keys, "pos", "w.*").where(ws[-1].isNotNull())
    blanks = sum((_is_slot(w).cast("int") for w in ws[1:]), _is_slot(ws[0]).cast("int"))
    counted = each.select(*keys, "pos", *ws, blanks.alias("blanks"))
    both = (ws[0] >= NAME) & _is_slot(ws[0]) & (F.col("blanks") <= 3) if inside else F.lit(False)
    ways = counted.select("*", F.explode(F.when(both, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("first"))
    dense = (F.col("blanks") > 2) & ~F.col("first")
    typed = ways.select(*keys, "pos", dense.alias("dense"), "first", F.when(F.col("first"), _value(ws[0])).otherwise(ws[0]).alias("w0"), *ws[1:])
    template = F.xxhash64(*[F.when(_is_slot(w), F.left(w, F.lit(1))).otherwise(w) for w in ws])
    literal = F.xxhash64(F.lit("literal"), *[_value(w) for w in ws])
    slots = F.when(F.col("dense"), F.array().cast("array<string>")).otherwise(_slots(_WORDS))
    return typed.select(*keys, "pos", F.when(F.col("dense"), literal).otherwise(template).alias("template"), "dense", "first", slots.alias("slots"))


def _is_slot(w: Column) -> Column:
    return (w >= NUM) & (w < "\x04")


def _value(w: Column) -> Column:
    return F.when(_is_slot(w), F.substring(w, 2, 1 << 30)).otherwise(w)


def _slots(names: list[str]) -> Column:
    return F.filter(F.array(*names), lambda w: _is_slot(w))


def contaminated(docs: DataFrame, benchmark: DataFrame, keys: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``keys``, item_id, coverage and reparameterised (some slot holds another value than the item's)."""
    own = {k: f"_k{i}" for i, k in enumerate(keys)}
    items = benchmark.select(F.col(item_id).alias("_item"), F.col(item_text).alias("_text"))
    item_windows = materialize(
        windows(items, ["_item"], F.col("_text")).select("_item", F.col("pos").alias("item_pos"), "template", "dense", F.col("slots").alias("item_slots")), "templates"
    )
    totals = item_windows.groupBy("_item").agg(F.count("*").alias("total"), F.count_if(~F.col("dense")).alias("total_telling"))
    wanted = F.broadcast(item_windows) if item_windows.count() <= BROADCAST_WINDOWS else item_windows
    renamed = docs.select(*[F.col(f"`{k}`").alias(n) for k, n in own.items()], F.col(text).alias("_text"))
    found = windows(renamed, [*own.values()], F.col("_text"), True).drop("dense")
    hits = found.join(wanted, "template").where(~F.col("first") | (F.col("item_pos") == 0))
    flat = hits.select(*own.values(), "_item", (F.col("pos") - F.col("item_pos")).alias("shift"), "item_pos", (~F.col("first") & ~F.col("dense")).alias("plain"), F.arrays_zip("item_slots", "slots").alias("pairs"))

    def joined(rows: Column) -> list[Column]:
        return [F.collect_set(F.when(rows, F.col("item_pos"))).alias("places"), F.array_distinct(F.flatten(F.collect_set(F.when(rows, F.col("pairs"))))).alias("pairs")]

    def scores(of: str) -> list[Column]:
        pairs = F.col(f"{of}.pairs")
        consistent = F.size(F.array_distinct(F.transform(pairs, lambda p: p["item_slots"]))) == F.size(pairs)
        n = F.size(F.array_distinct(F.flatten(F.collect_list(F.when(consistent, F.col(f"{of}.places"))))))
        return [n.alias(f"n_{of}"), F.max(F.when(consistent, F.exists(pairs, lambda p: p["item_slots"] != p["slots"]))).alias(f"other_{of}")]

    # telling windows alone tell first, as they also find new values; then all windows
    line = flat.groupBy(*own.values(), "_item", "shift").agg(F.struct(*joined(F.col("plain"))).alias("telling"), F.struct(*joined(F.lit(True))).alias("every"))
    per_item = line.groupBy(*own.values(), "_item").agg(*scores("telling"), *scores("every"))
    telling = F.try_divide("n_telling", "total_telling")
    enough = F.coalesce((telling >= COVERAGE) & (F.col("total_telling") * 2 >= F.col("total")), F.lit(False))
    scored = (
        per_item.join(totals, "_item")
        .select("*", F.when(enough, telling).otherwise(F.col("n_every") / F.col("total")).alias("coverage"), F.when(enough, F.col("other_telling")).otherwise(F.col("other_every")).alias("reparameterised"))
        .where(F.col("coverage") >= COVERAGE)
    )
    names = free_names(keys, [item_id, "coverage", "reparameterised"])
    return scored.select(*[F.col(n).alias(k) for k, n in zip(names, own.values())], F.col("_item").alias(item_id), "coverage", "reparameterised")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; rows are told apart by id and text hash."""
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    marks = [F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("_id"), F.xxhash64(text).alias("_hash")]
    found = contaminated(docs.select(*marks, F.col(text).alias("_body")), benchmark, ["_id", "_hash"], "_body").select("_id", "_hash").distinct()
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], *marks)
    return rows.join(materialize(found, "leaks"), ["_id", "_hash"], "left_anti").select(*[F.col(n).alias(c) for c, n in own.items()])


def oracle_sql() -> str:
    """The same windows and slots in DuckDB, compared as strings instead of hashes, dense windows and first words included."""
    units = "|".join(UNITS)
    slot, value = "(x >= chr(1) and x < chr(4))", "case when x >= chr(1) and x < chr(4) then x[2:] else x end"
    slots_of = f"list_filter(ws, lambda x: {slot})"

    def windows_of(table: str, key: str, inside: bool) -> str:
        plain = f"""(select {key}, i, t[i:i + {WINDOW - 1}] as ws from (select {key}, t, unnest(range(1, len(t) - {WINDOW - 2})) as i from (
          select {key}, list_transform(w, lambda x, i: translate(lower(case when regexp_matches(x, '[0-9]') then chr(1) || x
              when i > 1 and not regexp_matches(w[i - 1], '[.!?:]$') and regexp_matches(x, '\\p{{Lu}}') then chr(2) || x
              when i > 1 and regexp_matches(w[i - 1], '[0-9]') and regexp_matches(x, '^({units})([.,;:!?]|$)') then chr(3) || x else x end), '{_PUNCTUATION}', '')) as t
          from (select {key}, string_split(trim(regexp_replace(translate(coalesce(text, ''), chr(1) || chr(2) || chr(3), ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')), ' ') as w from {table})) where len(t) >= {WINDOW}))"""
        ways = f"(select {key}, i, ws, len({slots_of}) > 2 as dense, false as first from {plain})"
        if inside:
            opened = f"(select {key}, i, list_prepend(ws[1][2:], ws[2:]) as ws, false as dense, true as first from {plain} where ws[1] >= chr(2) and ws[1] < chr(4) and len({slots_of}) <= 3)"
            ways = f"(select * from {ways} union all select * from {opened})"
        return f"""(select {key}, i as pos, dense, first, case when dense then [] else {slots_of} end as slots,
          case when dense then chr(30) || array_to_string(list_transform(ws, lambda x: {value}), chr(31)) else array_to_string(list_transform(ws, lambda x: case when {slot} then left(x, 1) else x end), chr(31)) end as template
        from {ways})"""

    def told(of: str) -> str:
        return f"""len(list_distinct(list_transform(z{of}, lambda x: x[1]))) = len(z{of}) as ok_{of}, len(list_filter(z{of}, lambda x: x[1] <> x[2])) > 0 as other_{of}"""

    return f"""
    with items as {windows_of("benchmark", "item_id", False)}, docs as {windows_of("documents", "doc_id", True)},
      totals as (select item_id, count(*) as total, count(*) filter (not dense) as total_telling from items group by 1),
      hits as (select doc_id, item_id, docs.pos - items.pos as shift, items.pos as item_pos, not docs.first and not items.dense as plain, list_zip(items.slots, docs.slots) as z
               from docs join items using (template) where not docs.first or items.pos = 1),
      line as (select doc_id, item_id, shift, coalesce(list(distinct item_pos) filter (plain), []) as pt, list(distinct item_pos) as pe,
               coalesce(list_distinct(flatten(list(z) filter (plain))), []) as zt, list_distinct(flatten(list(z))) as ze from hits group by all),
      tested as (select *, {told("t")}, {told("e")} from line),
      per as (select doc_id, item_id, coalesce(len(list_distinct(flatten(list(pt) filter (ok_t)))), 0) as nt, coalesce(len(list_distinct(flatten(list(pe) filter (ok_e)))), 0) as ne,
              bool_or(other_t) filter (ok_t) as ot, bool_or(other_e) filter (ok_e) as oe from tested group by all),
      sums as (select *, total_telling * 2 >= total and total_telling > 0 and nt / total_telling >= {COVERAGE} as enough from per join totals using (item_id)),
      found as (select doc_id, item_id, case when enough then nt / total_telling else ne / total end as coverage, case when enough then ot else oe end as reparameterised from sums)
    select doc_id, item_id, coverage, reparameterised from found where coverage >= {COVERAGE}"""
