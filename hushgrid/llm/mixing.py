"""Mixing sources to target weights by hierarchical budgeting (operator 2).

Leaves of a tree domain > language > source hold documents; a leaf offers its tokens ``EPOCHS`` times at
most. The token budget flows from the root: siblings share what their parent got by integer weights; one
that can't use its share is filled to its capacity and the rest is shared among its siblings, and only
what a whole family can't use goes back to the parent's siblings. Each level is filled exactly by one
window over siblings in the order of capacity / weight (the capped ones are a prefix).

A leaf takes whole epochs, then a token-prefix of one more, in the order of md5(seed, epoch, document).
The prefix's last key is found in two steps, a histogram over 65,536 key ranges and then the keys of one
range, so no leaf is ever sorted in one task. Documents compare their key with their leaf's: no join on
documents, and the table of leaves is small.

Nulls in tree columns form a leaf of their own. A null or empty text has no tokens; it goes with every
whole epoch and with the prefix. Rows with the same id share a key and are taken together; a null id is
keyed by its text. Columns keep their names whatever they are. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

SEED = "mix-1"
EPOCHS = 3
#: Budget in thousandths of the tokens there are.
BUDGET_MILLE = 900
#: Integer weights; anything not named has weight ``OTHER``.
DOMAIN_WEIGHTS = {"web": 50, "books": 25, "code": 15, "wiki": 10}
LANG_WEIGHTS = {"en": 60, "de": 15, "fr": 15, "es": 10}
OTHER = 10
LEVELS = ("domain", "lang", "source")
RANGE_DIGITS = 4


def domain_of(source: Column) -> Column:
    """The four domains by the number at the end of a source's name; others have the domain ``web``."""
    n = F.pmod(F.coalesce(F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int"), F.lit(0)), F.lit(4))
    return F.element_at(F.array(*map(F.lit, ("web", "books", "code", "wiki"))), n + 1)


def _weights(c: str, table: dict[str, int]) -> Column:
    out = F.lit(OTHER)
    for k, v in table.items():
        out = F.when(F.col(c) == k, F.lit(v)).otherwise(out)
    return out.cast("long")


def fill(level: DataFrame, parents: list[str], budget: str = "budget") -> DataFrame:
    """``level`` (parents, weight, capacity, and the parent's ``budget``) with ``share``.

    Siblings in the order of capacity / weight: those before the first whose weighted part of the rest is
    below its capacity are filled, the others share the rest by weight, rounded down.
    """
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = by.orderBy((F.col("capacity") / F.col("weight")), "capacity", "node").rowsBetween(Window.unboundedPreceding, -1)
    step = level.withColumn("all_weight", F.sum("weight").over(by)).withColumn("full", F.coalesce(F.sum("capacity").over(order), F.lit(0))).withColumn("gone", F.coalesce(F.sum("weight").over(order), F.lit(0)))
    rest, left = F.col(budget) - F.col("full"), F.col("all_weight") - F.col("gone")
    step = step.withColumn("fits", (rest * F.col("weight")) < (F.col("capacity") * left))
    first = F.min(F.when(F.col("fits"), F.struct("gone", "full"))).over(by)
    step = step.withColumn("first", first)
    open_ = F.col("first").isNotNull() & (F.col("gone") >= F.col("first.gone"))
    part = F.expr(f"(({budget} - first.full) * weight) div (all_weight - first.gone)")
    return step.withColumn("share", F.when(open_, F.least(part, F.col("capacity"))).otherwise(F.col("capacity"))).drop("all_weight", "full", "gone", "fits", "first")


def _key(epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), epoch.cast("string"), F.col("_key")).cast("binary"))


def _tree(source: str, lang: str) -> list[Column]:
    return [F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("_source"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("")).alias("_lang")]


def _doc_key(id_col: str, text: str) -> Column:
    return F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")))).alias("_key")


def keyed(docs: DataFrame, id_col: str, text: str, source: str, lang: str) -> DataFrame:
    """id, domain, lang, source, _key and n_tokens of each row."""
    return docs.select(
        F.col(f"`{id_col}`").alias("_id"), *_tree(source, lang), _doc_key(id_col, text),
        F.regexp_count(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"),
    ).select("_id", domain_of(F.col("_source")).alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), "_key", "n_tokens")


def budgets(leaves: DataFrame, budget_mille: int = BUDGET_MILLE, epochs: int = EPOCHS) -> DataFrame:
    """leaves (domain, lang, source, tokens) with ``share``, the tokens that each is to give."""
    at = leaves.withColumn("capacity", F.col("tokens") * epochs)
    total = (leaves.agg(F.sum("tokens")).first()[0] or 0) * budget_mille // 1000
    domains = at.groupBy("domain").agg(F.sum("capacity").alias("capacity")).withColumn("budget", F.lit(total).cast("long"))
    domains = fill(domains.withColumn("weight", _weights("domain", DOMAIN_WEIGHTS)).withColumn("node", F.col("domain")), [])
    langs = at.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).join(domains.select("domain", F.col("share").alias("budget")), "domain")
    langs = fill(langs.withColumn("weight", _weights("lang", LANG_WEIGHTS)).withColumn("node", F.col("lang")), ["domain"])
    sources = at.join(langs.select("domain", "lang", F.col("share").alias("budget")), ["domain", "lang"])
    sources = fill(sources.withColumn("weight", F.lit(OTHER).cast("long")).withColumn("node", F.col("source")), ["domain", "lang"])
    return sources.select(*LEVELS, "tokens", "share")


def cuts(rows: DataFrame, budget_mille: int = BUDGET_MILLE, epochs: int = EPOCHS) -> DataFrame:
    """domain, lang, source, share, whole (epochs taken whole) and last (the prefix's last key, null if none).

    ``rows`` is read twice: pass a written table.
    """
    leaves = materialize(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    plan = materialize(
        budgets(leaves, budget_mille, epochs).withColumn("whole", F.expr("if(tokens = 0, 1, share div tokens)"))
        .withColumn("rest", F.expr("if(tokens = 0, 0, share % tokens)")), "plan",
    )
    part = rows.join(plan.where("rest > 0").select(*LEVELS, "whole", "rest"), [*LEVELS]).select(*LEVELS, "rest", _key(F.col("whole")).alias("k"), "n_tokens").withColumn("rng", F.substring("k", 1, RANGE_DIGITS))
    leaf = Window.partitionBy(*LEVELS)
    upto = lambda c: leaf.orderBy(c).rowsBetween(Window.unboundedPreceding, 0)
    ranges = part.groupBy(*LEVELS, "rest", "rng").agg(F.sum("n_tokens").alias("n")).withColumn("upto", F.sum("n").over(upto("rng")))
    edge = materialize(ranges.where("upto > rest").groupBy(*LEVELS).agg(F.min(F.struct("rng", (F.col("upto") - F.col("n")).alias("before"))).alias("e")).select(*LEVELS, "e.*"), "edges")
    inside = part.join(edge, [*LEVELS, "rng"])
    keys = inside.groupBy(*LEVELS, "rest", "before", "k").agg(F.sum("n_tokens").alias("n")).withColumn("upto", F.col("before") + F.sum("n").over(upto("k")))
    last_in = keys.where("upto <= rest").groupBy(*LEVELS).agg(F.max("k").alias("last_in"))
    ends = edge.join(last_in, [*LEVELS], "left").select(*LEVELS, F.coalesce("last_in", "rng").alias("last"))
    return materialize(plan.join(ends, [*LEVELS], "left").select(*LEVELS, "share", "whole", "last"), "cuts")


def _copies() -> Column:
    return (F.col("whole") + F.when(_key(F.col("whole")) <= F.col("last"), 1).otherwise(0)).cast("int")


def select_mix(docs: DataFrame, id_col="doc_id", text="text", source="source", lang="lang", budget_mille: int = BUDGET_MILLE, epochs: int = EPOCHS) -> DataFrame:
    """id, domain, lang, source, n_tokens and copies (0: left out) of every row."""
    rows = materialize(keyed(docs, id_col, text, source, lang), "keyed")
    chosen = rows.join(cuts(rows, budget_mille, epochs), [*LEVELS])
    return chosen.select(F.col("_id").alias(id_col), *LEVELS, "n_tokens", _copies().alias("copies"))


def mix(docs: DataFrame, id_col="doc_id", text="text", source="source", lang="lang", budget_mille: int = BUDGET_MILLE, epochs: int = EPOCHS) -> DataFrame:
    """The rows of ``docs``, each as often as it was chosen, with the columns of ``docs``."""
    rows = materialize(keyed(docs, id_col, text, source, lang), "keyed")
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    full = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], *_tree(source, lang), _doc_key(id_col, text))
    full = full.withColumn("domain", domain_of(F.col("_source"))).withColumnsRenamed({"_lang": "lang", "_source": "source"})
    chosen = full.join(cuts(rows, budget_mille, epochs), [*LEVELS]).withColumn("copies", _copies()).where("copies > 0")
    return chosen.select(*[F.col(n).alias(c) for c, n in own.items()], F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")


def _fill_sql(source: str, parents: str, node: str) -> str:
    by = f"partition by {parents}" if parents else ""
    order = f"({by} order by capacity / weight, capacity, {node} rows between unbounded preceding and 1 preceding)"
    lead = f"{parents}, " if parents else ""
    return f"""(select *, case when gone >= g then least(((budget - f) * weight) // (alls - g), capacity) else capacity end as share from (
      select *, arg_min(gone, gone) filter (where fits) over ({by}) as g, arg_min(full_, gone) filter (where fits) over ({by}) as f from (
        select *, (budget - full_) * weight < capacity * (alls - gone) as fits from (
          select *, sum(weight) over ({by})::hugeint as alls, coalesce(sum(capacity) over {order}, 0)::hugeint as full_, coalesce(sum(weight) over {order}, 0)::hugeint as gone from {source}))))"""


def oracle_sql() -> str:
    weight = lambda c, t: "case " + " ".join(f"when {c} = '{k}' then {v}" for k, v in t.items()) + f" else {OTHER} end"
    return f"""
    with d as (select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang, coalesce(doc_id::varchar, 't' || md5(coalesce(text, ''))) as key,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as n_tokens,
        ['web', 'books', 'code', 'wiki'][coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) as int), 0) % 4 + 1] as domain from documents),
      leaves as (select domain, lang, source, sum(n_tokens)::hugeint as tokens, sum(n_tokens)::hugeint * {EPOCHS} as capacity from d group by all),
      doms as (select * from {_fill_sql(f"(select domain, sum(capacity)::hugeint as capacity, (select sum(tokens)::hugeint * {BUDGET_MILLE} // 1000 from leaves) as budget, {weight('domain', DOMAIN_WEIGHTS)} as weight from leaves group by domain)", '', 'domain')}),
      lans as (select * from {_fill_sql(f"(select l.domain, l.lang, l.capacity, doms.share as budget, {weight('l.lang', LANG_WEIGHTS)} as weight from (select domain, lang, sum(capacity)::hugeint as capacity from leaves group by all) l join doms using (domain))", 'domain', 'lang')}),
      srcs as (select * from {_fill_sql(f"(select leaves.domain, leaves.lang, leaves.source, tokens, leaves.capacity, lans.share as budget, {OTHER} as weight from leaves join lans using (domain, lang))", 'domain, lang', 'source')}),
      plan as (select *, case when tokens = 0 then 1 else share // tokens end as whole, case when tokens = 0 then 0 else share % tokens end as rest from srcs),
      k as (select d.*, whole, rest, md5('{SEED}:' || whole || ':' || key) as k from d join plan using (domain, lang, source)),
      run as (select *, sum(n_tokens) over (partition by domain, lang, source order by k range between unbounded preceding and current row) as upto from k)
    select doc_id, domain, lang, source, n_tokens::bigint as n_tokens, (whole + case when rest > 0 and upto <= rest then 1 else 0 end)::int as copies from run"""
