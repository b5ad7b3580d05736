"""Source divergence audit (operator 11): how far sources of a language differ in their words.

Each language keeps the terms in at least ``LEAST_DOCUMENTS`` of its documents. A group (language, source) gives
every kept term a smoothed integer price, ``1 + (SCALE * (count + ADDED)) div (N + ADDED * V)``, N being the sum of the
group's counts of kept terms and V the number of kept terms. Two sources differ by the sum of |p - q| over all kept terms.

That sum comes from joint tables: with an indicator column for each (group, count level), level 0 included, the
product of the transposed matrix of terms with itself holds for each two groups and levels how many
terms have both. Each cell is priced once with |p - q|. The matrix is cut into blocks of about ``TERMS`` terms and pairs
of blocks of ``GROUPS`` groups; a task multiplies one block's columns (0 and 1 in single precision, exact below
2^24) and prices its tables in 64-bit integers, so a block's memory doesn't grow with the input. Terms that no group of a pair of
blocks has are in no block; they count as V less those seen, at the two groups' level 0.

Words are counted in tasks, batch by batch, before the first shuffle; nothing whole reaches the driver or
one task. The table of pairs is quadratic in the sources of a language, as its result is.

Null text, language and source count as ''. A group without kept terms has its prices for level 0; a language
without kept terms has value 0 for each pair and no terms. A language's only source has no pairs. Repeated rows
count each, very long texts whole, an empty table gives no rows, other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, lower_ascii, materialize

#: Terms are runs of ASCII letters and of all beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCUMENTS, SCALE, ADDED, TOP = 30, 1_000_000_000, 5, 50
#: Terms and groups of a block.
TERMS, GROUPS = 512, 8
#: Entries that a task gathers before it passes them on.
HELD = 300_000
_TERM = re.compile(TERM)


def term_counts(df: DataFrame, lang: Column, source: Column, text: Column) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and texts of each term, summed."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: dict[tuple[str, str], Counter] = {}
        docs: dict[tuple[str, str], Counter] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for k, c in n.items():
                if c:
                    yield pd.DataFrame({"lang": k[0], "source": k[1], "term": list(c), "n": list(c.values()), "docs": list(map(docs[k].__getitem__, c))})
            n.clear()
            docs.clear()

        for b in batches:
            for key, rows in b.groupby(["lang", "source"], sort=False)["text"]:
                total, seen = n.setdefault(key, Counter()), docs.setdefault(key, Counter())
                for t in rows:
                    words = _TERM.findall(lower_ascii(t))
                    total.update(words)
                    seen.update(set(words))
            if sum(map(len, n.values())) > HELD:
                yield from flush()
        yield from flush()

    rows = df.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source"), F.coalesce(text, F.lit("")).alias("text"))
    counted = rows.mapInPandas(count, "lang string, source string, term string, n long, docs long")
    # by language and term, so that the language's sums need no other shuffle
    return counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame) -> DataFrame:
    """(lang, source, term, n, lang_n, first): counts of the kept terms; ``first`` marks one row of each term."""
    by = Window.partitionBy("lang", "term")
    known = counts.select("*", F.sum("docs").over(by).alias("_docs"), F.sum("n").over(by).alias("lang_n"), (F.row_number().over(by.orderBy("source")) == 1).alias("first"))
    return known.where(F.col("_docs") >= LEAST_DOCUMENTS).select("lang", "source", "term", "n", "lang_n", "first")


def _price(n: Column, total: Column, terms: Column) -> Column:
    """Exact price of a count; 0 without kept terms."""
    whole = lambda c: c.cast("decimal(38,0)")
    scaled, over = (whole(n) + ADDED) * SCALE, whole(total) + whole(terms) * ADDED
    return F.when(terms > 0, 1 + F.call_function("div", scaled, F.greatest(over, F.lit(1)))).otherwise(0).cast("long")


def groups_of(df: DataFrame, kept: DataFrame, lang: Column, source: Column) -> DataFrame:
    """(lang, source, total, lang_total, terms, p0, block, blocks, term_blocks) of every group that occurs."""
    every = df.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source")).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.when(F.col("first"), 1)).alias("terms"))
    by = Window.partitionBy("lang")
    out = every.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "lang_total", "terms"])
    place = F.row_number().over(by.orderBy("source")) - 1
    return out.select(
        "*", _price(F.lit(0), F.col("total"), F.col("terms")).alias("p0"), F.floor(place / GROUPS).cast("int").alias("block"),
        F.ceil(F.count("*").over(by) / GROUPS).cast("int").alias("blocks"), F.greatest(F.ceil(F.col("terms") / TERMS), F.lit(1)).cast("int").alias("term_blocks"),
    )


def _columns(rows: pd.DataFrame, heads: pd.DataFrame, terms: int) -> tuple[np.ndarray, np.ndarray, list[slice]]:
    """Indicator columns of a block's groups, in the order of ``heads``, their prices, and each group's columns; the first is level 0."""
    widths, parts = [], []
    for source, p0 in zip(heads["source"], heads["p"]):
        own = rows[rows["source"] == source]
        levels, at = np.unique(own["n"].to_numpy(np.int64), return_inverse=True)
        price = np.full(len(levels) + 1, p0, np.int64)
        price[at + 1] = own["p"].to_numpy(np.int64)
        cells = np.zeros((terms, len(levels) + 1), np.float32)
        cells[:, 0] = 1
        cells[own["t"], 0] = 0
        cells[own["t"], at + 1] = 1
        widths.append(len(price))
        parts.append((cells, price))
    ends = np.cumsum([0, *widths])
    return np.hstack([c for c, _ in parts]), np.concatenate([p for _, p in parts]), [slice(a, b) for a, b in zip(ends, ends[1:])]


def _priced(block: pd.DataFrame) -> pd.DataFrame:
    """(lang, a, b, value, seen) of each two groups: the joint tables of the block's terms, each cell at its price."""
    heads, rows = block[block["term"].isna()], block[block["term"].notna()].copy()
    rows["t"], known = pd.factorize(rows["term"])
    i, j = block["i"].iloc[0], block["j"].iloc[0]
    order = lambda n: heads[heads["block"] == n].sort_values("source")
    left, right = order(i), order(j)
    x, px, own = _columns(rows[rows["block"] == i], left, len(known))
    y, py, other = (x, px, own) if i == j else _columns(rows[rows["block"] == j], right, len(known))
    firsts = np.array([s.start for s in other])
    out = []
    for n, (a, cols) in enumerate(zip(left["source"], own)):
        joint = (x[:, cols].T @ y).astype(np.int64)  # levels of one group by those of the block's other groups
        value = np.add.reduceat((joint * np.abs(px[cols, None] - py[None, :])).sum(axis=0), firsts)
        out += [(a, b, v) for b, v in list(zip(right["source"], value.tolist()))[n + 1 if i == j else 0 :]]
    done = pd.DataFrame(out, columns=["a", "b", "value"])
    done.insert(0, "lang", block["lang"].iloc[0])
    done["seen"] = len(known)
    return done


def source_pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the difference of every source from every other of its language."""
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ends = [F.least("block", "_p").alias("i"), F.greatest("block", "_p").alias("j")]
    price = _price(F.col("n"), F.col("total"), F.col("terms"))
    term_block = F.pmod(F.xxhash64("term"), F.col("term_blocks").cast("long")).cast("int")
    entries = kept.join(groups, ["lang", "source"]).select("lang", "source", "block", "blocks", "term", "n", price.alias("p"), term_block.alias("k"))
    heads = groups.select("lang", "source", "block", "blocks", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.col("p0").alias("p"), F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("k"))
    dealt = entries.unionByName(heads).select("*", partner.alias("_p")).select("lang", "k", *ends, "source", "block", "term", "n", "p")
    part = dealt.groupBy("lang", "k", "i", "j").applyInPandas(_priced, "lang string, a string, b string, value long, seen long")
    sums = part.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    zero = lambda n: groups.select("lang", F.col("source").alias(n), "terms", F.col("p0").alias(f"p_{n}"))
    rest = (F.col("terms") - F.col("seen")) * F.abs(F.col("p_a") - F.col("p_b"))
    whole = sums.join(zero("a"), ["lang", "a"]).join(zero("b").drop("terms"), ["lang", "b"]).select("lang", "a", "b", (F.col("value") + rest).alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return whole.select("lang", both.alias("s"), "value").select("lang", "s.*", "value")


def source_terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): kept terms that a group has more of than its language."""
    p, q = _price(F.col("n"), F.col("total"), F.col("terms")), _price(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    return kept.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")


def audit(df: DataFrame, lang: Column, source: Column, text: Column) -> DataFrame:
    """lang, source, part (``pair``, ``term``), item, value, rank: all other sources of a group's language, and its ``TOP`` terms, largest first."""
    kept = materialize(kept_terms(term_counts(df, lang, source, text)), "terms")
    groups = materialize(groups_of(df, kept, lang, source), "groups")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.cast("int").alias("rank"))
    return ranked(source_pairs(kept, groups), "pair").unionByName(ranked(source_terms(kept, groups), "term").where(F.col("rank") <= TOP))


def oracle_sql() -> str:
    """Every kept term of every two sources, subtracted one by one."""
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS w FROM documents),
    tok AS (SELECT r, lang, source, unnest(w) AS term FROM d),
    kept AS (SELECT lang, term FROM tok GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
    v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
    cnt AS (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY lang, source, term),
    grp AS (SELECT DISTINCT lang, source FROM d),
    tot AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM grp g LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
    p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {ADDED})) // (t.total + {ADDED} * v.v) AS p
          FROM tot t JOIN kept k ON k.lang = t.lang JOIN v ON v.lang = t.lang LEFT JOIN cnt c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
    q AS (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (sum(n) + {ADDED})) // (sum(sum(n)) OVER (PARTITION BY lang) + {ADDED} * count(*) OVER (PARTITION BY lang)) AS q FROM cnt GROUP BY lang, term),
    pairs AS (SELECT a.lang, a.source, b.source AS item FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source),
    diff AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    found AS (SELECT lang, source, 'pair' AS part, item, coalesce(f, 0)::BIGINT AS value FROM pairs LEFT JOIN diff USING (lang, source, item)
              UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM found
    QUALIFY part = 'pair' OR rank <= {TOP}"""
