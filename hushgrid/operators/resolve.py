"""Allowlists, policies, order and overlap: from candidates to the spans that count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import kinds
from ..functions import text as tx
from ..functions import validators as v


def effective_allowlist(entries: DataFrame, session: DataFrame | None, site: str, as_of: str) -> DataFrame:
    """Global entries, the site's live ones and those of the session.

    entries: value, scope (global, site), site_id, expires_at. session: value.
    """
    live = entries.where((F.col("scope") == "global") | ((F.col("scope") == "site") & (F.col("site_id") == site) & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of).cast("timestamp")))))
    out = live.select("value", "scope", "expires_at")
    return out if session is None else out.unionByName(session.select("value", F.lit("session").alias("scope"), F.lit(None).cast("timestamp").alias("expires_at")))


def allowlisted(cands: DataFrame, allow: DataFrame) -> DataFrame:
    """Candidates that no entry lets pass: anti joins on the plain value, and on the kind with the canonical one, with
    the rule that high-risk kinds heed session entries and expiring site entries alone."""
    strong = (F.col("scope") == "session") | ((F.col("scope") == "site") & F.col("expires_at").isNotNull())
    entries = allow.where(F.col("value").isNotNull()).select("value", F.coalesce(strong, F.lit(False)).alias("_strong"))
    plain = entries.groupBy(F.trim(tx.plain(F.col("value"))).alias("_key")).agg(F.bool_or("_strong").alias("_strong"))
    names = F.array(*[F.lit(k) for k in kinds.NAMES])
    typed = entries.select("value", "_strong", F.explode(names).alias("_kind")).groupBy("_kind", tx.canonical(F.col("_kind"), F.col("value")).alias("_key")).agg(F.bool_or("_strong").alias("_strong"))
    grants = F.col("_strong") | ~kinds.high_risk(F.col("kind"))
    # each distinct value is looked up once: a frequent one would gather its candidates in one task
    value = ["kind", "raw", "normalized"]
    asked = cands.select(*value).distinct()
    by_plain = asked.join(plain, (F.trim(tx.plain(F.col("raw"))) == F.col("_key")) & grants, "left_semi")
    by_kind = asked.join(typed, (F.col("kind") == F.col("_kind")) & (F.col("normalized") == F.col("_key")) & grants, "left_semi")
    passing = by_plain.union(by_kind).distinct().select(*[F.col(c).alias(f"_p_{c}") for c in value])
    same = [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in value]
    return cands.join(passing, same, "left_anti")


def merge_allowlists(a: DataFrame, b: DataFrame) -> DataFrame:
    """(value, site_id, expires_at): one row for each pair; the later expiry wins, none is for ever."""
    return a.select("value", "site_id", "expires_at").unionByName(b.select("value", "site_id", "expires_at")).groupBy("value", "site_id").agg(
        F.when(F.count("*") == F.count("expires_at"), F.max("expires_at")).alias("expires_at")
    )


def site_policies(base: DataFrame, overlay: DataFrame, site: str) -> DataFrame:
    """(kind, action): the site's overlay over the global policies; the last overlay row of a kind wins (by seq)."""
    last = overlay.where(F.col("site_id") == site).groupBy("kind").agg(F.max_by("action", "seq").alias("over"))
    return base.join(last, "kind", "full_outer").select("kind", F.coalesce("over", "action").alias("action"))


def all_site_policies(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """(site_id, kind, action) of every site that has an overlay row: the last one of a kind over the global policies."""
    last = overlay.groupBy("site_id", "kind").agg(F.max_by("action", "seq").alias("over"))
    every = overlay.select("site_id").distinct().select("site_id", F.explode(F.array(*map(F.lit, kinds.NAMES))).alias("kind")).join(base.select("kind", "action"), "kind")
    return every.join(last, ["site_id", "kind"], "full_outer").select("site_id", "kind", F.coalesce("over", "action").alias("action"))


def with_policy(cands: DataFrame, policies: DataFrame) -> DataFrame:
    """Candidates with the policy of their kind. ``confirm`` never becomes ``replace``; other actions than
    ``replace`` make the decision ``block``."""
    joined = cands.join(policies.select("kind", F.col("action").alias("_action")), "kind", "left")
    kept = F.when((F.col("_action") == "replace") & (F.col("policy") == "confirm"), F.col("policy")).otherwise(F.coalesce("_action", "policy"))
    decision = F.when(F.col("_action") != "replace", "block").otherwise(F.col("decision"))
    return joined.withColumn("decision", decision).withColumn("policy", kept).drop("_action")


def rank(policy: Column, decision: Column) -> Column:
    """3: blocks; 2: asks; 1: replaces."""
    return F.when((policy == "block") | (policy.isNull() & (decision == "block")), 3).when(policy == "confirm", 2).otherwise(1)


def inferred(kind: Column, source: Column) -> Column:
    return F.coalesce((source == "semantic") | ((source == "context") & kind.isin("person_name", "address", "account")), F.lit(False))


def order_keys() -> list[Column]:
    """The total order of candidates, best first."""
    r, inf = rank(F.col("policy"), F.col("decision")), inferred(F.col("kind"), F.col("source"))
    source = F.when(F.col("source") == "structured", 3).when(F.col("source").isNull(), 2).when(F.col("source") == "context", 1).otherwise(0)
    return [
        F.when(r == 3, 0).otherwise(1), inf.cast("int"), -r, F.when(F.col("decision") == "block", 0).otherwise(1), -source,
        F.col("start"), F.col("start") - F.col("end"), kinds.priority(F.col("kind")), F.col("seq"),
    ]


def ranked(cands: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates with ``ord``, their place in the total order of their document."""
    return cands.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_keys())))


FIELDS = ["start", "end", "kind", "decision", "policy", "source", "raw", "normalized"]


def islands(spans: DataFrame, keys: list[str]) -> DataFrame:
    """``spans`` with island: numbers groups of spans of a document that overlaps chain together."""
    by = Window.partitionBy(*keys).orderBy("start", "end")
    new = (F.col("start") >= F.coalesce(F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int")
    return spans.withColumn("_new", new).withColumn("island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def _apart(cs: Column) -> Column:
    """Candidates of an island, where a card gives the digits it shares with an IPv4 address up, if what is left is a card."""
    has = lambda kind: F.exists(cs, lambda x: x["c"]["kind"] == kind)

    def cut(x: Column) -> Column:
        start, end = x["c"]["start"], x["c"]["end"]
        shared = F.filter(cs, lambda y: (y["c"]["kind"] == "ipv4") & (y["c"]["start"] < end) & (start < y["c"]["end"]))
        low = F.array_max(F.transform(shared, lambda y: F.when(y["c"]["start"] <= start, y["c"]["end"]).otherwise(start)))
        high = F.array_min(F.transform(shared, lambda y: F.when(y["c"]["start"] > start, y["c"]["start"]).otherwise(end)))
        rest = F.rtrim(F.substring(x["c"]["raw"], low - start + 1, high - low), F.lit(" -"))
        left = F.ltrim(rest, F.lit(" -"))
        own = v.luhn(left) & (x["c"]["kind"] == "bank_card")
        at = low + F.length(rest) - F.length(left)
        c = x["c"].withField("start", at).withField("end", at + F.length(left)).withField("raw", left).withField("normalized", tx.canonical(F.lit("bank_card"), left))
        return F.when(own, x.withField("c", c)).otherwise(x)

    return F.when(has("bank_card") & has("ipv4"), F.transform(cs, cut)).otherwise(cs)


def select_spans(cands: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates that overlap no better one of their document: a fold over each island of overlapping ones,
    so that a document of many candidates costs no more than its islands."""
    fields = FIELDS + [c for c in ("warning",) if c in cands.columns]
    packed = F.struct(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order_keys())]).alias("o"), F.struct(*fields).alias("c"))
    docs = islands(cands, keys).groupBy(*keys, "island").agg(F.array_sort(F.collect_list(packed)).alias("cs")).withColumn("cs", _apart(F.col("cs")))
    kept = F.when(F.size("cs") == 1, F.col("cs")).otherwise(F.expr(
        "aggregate(cs, slice(cs, 1, 0), (acc, x) -> if(exists(acc, y -> y.c.start < x.c.end and x.c.start < y.c.end), acc, array_append(acc, x)))"
    ))
    return docs.select(*keys, F.explode(kept).alias("x")).select(*keys, "x.c.*")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Spans of one document that overlap; semi and anti forms by ``how``."""
    a, b = left.alias("l"), right.alias("r")
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    cond = (F.col("l.start") < F.col("r.end")) & (F.col("r.start") < F.col("l.end"))
    for s in same:
        cond = cond & s
    return a.join(b, cond, how)


def drop_contained(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct spans that no earlier wider one of their kind contains: a running maximum of the ends."""
    by = Window.partitionBy(*keys, "kind").orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return spans.select(*keys, "kind", "start", "end").distinct().withColumn("reach", F.max("end").over(by)).where(F.col("end") > F.coalesce("reach", F.lit(-1))).drop("reach")


def highlights(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Segments between all boundaries, each of the kind of lowest rank over it, equal neighbours merged. Boundaries
    meet the spans of their own island of overlaps alone, within one row."""
    s = islands(spans.select(*keys, "kind", "start", "end"), keys)
    packed = F.struct("start", "end", kinds.priority(F.col("kind")).alias("prio"), "kind")
    each = s.groupBy(*keys, "island").agg(F.collect_list(packed).alias("cs")).withColumn("xs", F.array_sort(F.array_distinct(F.concat("cs.start", "cs.end"))))
    best = F.expr("""filter(transform(slice(xs, 1, size(xs) - 1), (x, i) -> named_struct('x', x, 'y', xs[i + 1],
        'b', array_min(transform(filter(cs, c -> c.start < xs[i + 1] and x < c.end), c -> named_struct('prio', c.prio, 'kind', c.kind))))), s -> s.b is not null)""")
    cut = each.select(*keys, F.explode(best).alias("s")).select(*keys, "s.x", "s.y", F.col("s.b.kind").alias("kind"))
    w = Window.partitionBy(*keys).orderBy("x")
    new = F.when((F.lag("y").over(w) == F.col("x")) & (F.lag("kind").over(w) == F.col("kind")), 0).otherwise(1)
    run = cut.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return run.groupBy(*keys, "run", "kind").agg(F.min("x").alias("start"), F.max("y").alias("end")).drop("run")
