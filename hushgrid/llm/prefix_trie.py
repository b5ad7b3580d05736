"""Prefix trie of conversations (operator 13): member intervals by range minima over sorted common prefixes.

Conversations are sorted by their turns' digests and then by id, over ranges that also split a group of equal
conversations; a row's rank is its place in this order, and its LCP the number of first turns it shares with the
row before. The members of a prefix of d turns are an interval of ranks. Each candidate prefix (rank, d) finds its two
ends by itself: binary search in a sparse table of minima of the LCPs goes left to the last row with an LCP under d and right to the
first one. Sparse tables cover blocks of ``BLOCK`` ranks. A search that leaves its block goes on over the minima of
the blocks, the same way and as often as there are levels, and ends inside one other block; all searches that
leave a block with the same d are one. A block's table and queries are all that a task holds.

Sums over a subtree need no walk either: the nodes that start in ranks after the first to the last one of an interval, and the
deeper ones of its first rank, are its subtree, so two running sums over ranks and one within a rank give it.

Turns are compared by 128-bit digests of role and text. Turns of one conversation are gathered as such digests, 24
bytes a turn, in one row; of equal turn numbers the order is by role and digest. The list of the
conversations that end at a node is hashed as a stream, block by block, so it is never held whole.

Rows without a conversation id take no part; null turns come first, null roles and texts are empty. Repeated rows
are further turns. An empty table gives no rows. Very long texts are only digested and counted, other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

BLOCK = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Conversations that open with the turns of another: that of the next lower multiple of this, its first h turns, h under ``HEADS``.
SHARE, HEADS = 20, 4


def sequences(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (digest, words)."""
    who, what = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, what).cast("binary")))
    rows = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("turn"), who.alias("role"), digest.alias("digest"), F.regexp_count(what, F.lit(WORD)).alias("words")).alias("t")
    )
    in_order = F.sort_array(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(in_order, lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def share_openings(seqs: DataFrame) -> DataFrame:
    """Each conversation with its first h turns taken from the conversation at the next lower multiple of ``SHARE``."""
    openings = seqs.where(F.col("conv_id") % SHARE == 0).select(F.col("conv_id").alias("_from"), F.slice("turns", 1, HEADS - 1).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    own = seqs.withColumn("_from", F.col("conv_id") - F.col("conv_id") % SHARE).join(openings, "_from", "left")
    head = F.coalesce(F.slice("_head", F.lit(1), h), F.slice("turns", 1, 0))
    return own.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).alias("turns"))


def sorted_prefixes(seqs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(rank, block, conv_id, len, lcp, words): conversations in order; the first one's LCP is -1."""
    keyed = seqs.select("conv_id", F.transform("turns", lambda t: t["digest"]).alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))
    rows = materialize(keyed.orderBy("key", "conv_id").withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")  # one row for each task of the sort
    ranked = rows.withColumn("_part", part).join(sizes.select("_part", before.alias("_before")), "_part").select((F.col("_before") + place).alias("rank"), "conv_id", "key", "words")
    own = F.floor(F.col("rank") / block).cast("long")
    # the last row of a block is also seen by the next one
    seen = ranked.select("*", F.explode(F.when(F.col("rank") % block == block - 1, F.array(own, own + 1)).otherwise(F.array(own))).alias("block"))
    same = F.array_position(F.zip_with(F.lag("key").over(Window.partitionBy("block").orderBy("rank")), "key", lambda x, y: x.eqNullSafe(y)), F.lit(False))
    lcp = F.when(F.col("rank") == 0, -1).otherwise(F.coalesce(F.nullif(same, F.lit(0).cast("long")) - 1, F.size("key").cast("long")))
    out = seen.select("rank", "block", "conv_id", F.size("key").alias("len"), lcp.cast("int").alias("lcp"), "words").where(F.floor(F.col("rank") / block) == F.col("block"))
    return materialize(out, "prefixes")


def _search(v: np.ndarray, at: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last place before ``at`` and the first one after it with a value under ``d``: -1 and len(v) where there is none."""
    minima = [v]
    while 2 << len(minima) - 1 <= len(v):
        half = 1 << len(minima) - 1
        minima.append(np.minimum(minima[-1][:-half], minima[-1][half:]))
    left, right = at - 1, at + 1
    for k in reversed(range(len(minima))):
        low, step = left - (1 << k) + 1, 1 << k
        left = left - np.where((low >= 0) & (minima[k][np.maximum(low, 0)] >= d), step, 0)
        fits = right + step <= len(v)
        right = right + np.where(fits & (minima[k][np.where(fits, right, 0)] >= d), step, 0)
    return left, right


def _found(base: int, left: np.ndarray, right: np.ndarray, size: int) -> dict:
    """Places of the whole array; -1 where a search left its block."""
    return {"left": np.where(left < 0, -1, base + left), "right": np.where(right >= size, -1, base + right)}


def _candidates(rows: pd.DataFrame) -> pd.DataFrame:
    """Every prefix of a block's rows with its ends, as far as they are inside."""
    rows = rows.sort_values("rank")
    lcp, size, base = rows["lcp"].to_numpy(np.int64), rows["len"].to_numpy(np.int64), int(rows["rank"].iloc[0])
    at = np.repeat(np.arange(len(rows)), size)
    d = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size) + 1
    after = np.append(lcp[1:], np.iinfo(np.int64).max)  # what follows the last row isn't known here
    left, right = at.copy(), at + 1
    shared = (d <= lcp[at]) | (d <= after[at])
    found = _search(lcp, at[shared], d[shared])
    left[shared] = np.where(lcp[at[shared]] < d[shared], at[shared], found[0])
    right[shared] = found[1]
    own = {c: np.repeat(rows[c].to_numpy(), size) for c in ("rank", "block", "conv_id", "len", "lcp")}
    return pd.DataFrame(own | {"d": d} | _found(base, left, right, len(rows)))


def _outward(values: DataFrame, n: int, queries: DataFrame, block: int) -> DataFrame:
    """(at, d, left, right) of ``queries`` (at, d) over ``values`` (at, v): the nearest places with a value under d, -1 and ``n`` if none."""

    def look(vals: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        vals = vals.sort_values("at")
        base, at, d = int(vals["at"].iloc[0]), asked["at"].to_numpy(np.int64), asked["d"].to_numpy(np.int64)
        left, right = _search(vals["v"].to_numpy(np.int64), at - base, d)
        return pd.DataFrame({"at": at, "d": d} | _found(base, left, right, len(vals)))

    by = F.floor(F.col("at") / block).alias("b")
    found = values.groupBy(by).cogroup(queries.groupBy(by)).applyInPandas(look, "at long, d int, left long, right long")
    return _closed(values, n, materialize(found, "ends"), F.col("at"), block)


def _closed(values: DataFrame, n: int, found: DataFrame, at: Column, block: int) -> DataFrame:
    """``found`` with the ends that lie outside the block of ``at``."""
    if n <= block:
        return found.withColumn("right", F.when(F.col("right") < 0, n).otherwise(F.col("right")))

    def edges(vals: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        vals = vals.sort_values("at")
        at, v, d = vals["at"].to_numpy(np.int64), vals["v"].to_numpy(np.int64), asked["d"].to_numpy(np.int64)
        out = [np.flatnonzero(v < x)[[0, -1]] for x in d]
        return pd.DataFrame({"b": asked["b"], "d": d, "first": [at[i] for i, _ in out], "last": [at[j] for _, j in out]})

    own, by = F.floor(at / block), F.floor(F.col("at") / block)
    minima = values.groupBy(by.alias("at")).agg(F.min("v").alias("v"))
    leaving = found.where((F.col("left") < 0) | (F.col("right") < 0)).select(own.alias("at"), "d").distinct()
    blocks = -(-n // block)
    up = materialize(_outward(minima, blocks, leaving, block), "levels")
    asked = up.select(F.explode(F.array("left", "right")).alias("b"), "d").where((F.col("b") >= 0) & (F.col("b") < blocks)).distinct()
    inside = materialize(values.groupBy(by.alias("b")).cogroup(asked.groupBy("b")).applyInPandas(lambda v, q: edges(v, q) if len(q) else pd.DataFrame({"b": [], "d": [], "first": [], "last": []}), "b long, d int, first long, last long"), "edges")
    outer = (
        up.join(inside.select(F.col("b").alias("left"), "d", "last"), ["left", "d"], "left").join(inside.select(F.col("b").alias("right"), "d", "first"), ["right", "d"], "left")
        .select(F.col("at").alias("_b"), "d", F.coalesce("last", F.lit(-1)).alias("_left"), F.coalesce("first", F.lit(n)).alias("_right"))
    )
    whole = found.withColumn("_b", own).join(outer, ["_b", "d"], "left")
    pick = lambda c: F.when(F.col(c) < 0, F.col(f"_{c}")).otherwise(F.col(c))
    return whole.withColumn("left", pick("left")).withColumn("right", pick("right")).drop("_b", "_left", "_right")


def member_intervals(prefixes: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """(rank, block, conv_id, len, lcp, d, left, right): each row's every prefix with the first rank of its members and the first one behind them."""
    found = prefixes.select("rank", "block", "conv_id", "len", "lcp").groupBy("block").applyInPandas(_candidates, "rank long, block long, conv_id long, len int, lcp int, d int, left long, right long")
    return materialize(_closed(prefixes.select(F.col("rank").alias("at"), F.col("lcp").alias("v")), n, materialize(found, "candidates"), F.col("rank"), block), "intervals")


def _ends(intervals: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(left, d, ends_sha256) of the nodes at which conversations end."""
    ending = intervals.where("d = len").select("left", "d", "block", "conv_id").unionByName(prefixes.where("len = 0").select(F.lit(0).cast("long").alias("left"), F.lit(0).alias("d"), "block", "conv_id"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = materialize(ending.groupBy("left", "d", "block").agg(ids.alias("ids")), "endings")
    counts = parts.groupBy("left", "d").agg(F.count("*").alias("parts"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sha = None, None
        for b in batches:
            done = []
            for left, d, ids in zip(b["left"], b["d"], b["ids"]):
                if (left, d) != now:
                    if now is not None:
                        done.append((*now, sha.hexdigest()))
                    now, sha = (left, d), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=["left", "d", "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(*now, sha.hexdigest())], columns=["left", "d", "ends_sha256"])

    both = parts.join(counts, ["left", "d"])
    one = both.where("parts = 1").select("left", "d", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    many = both.where("parts > 1").select("left", "d", "block", "ids").repartition("left", "d").sortWithinPartitions("left", "d", "block")
    return one.unionByName(many.mapInPandas(digest, "left long, d int, ends_sha256 string"))


def trie(seqs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each distinct prefix of ``seqs`` (conv_id, turns), the empty one included.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    prefixes = sorted_prefixes(seqs, block)
    root = prefixes.agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.max("len").alias("len")).first()
    n = root.n
    intervals = member_intervals(prefixes, n, block)
    top = seqs.sparkSession.createDataFrame([(0, 0, root.conv_id, n, root.len)] if n else [], "left long, d int, conv_id long, right long, longest int")
    grouped = intervals.groupBy("left", "d").agg(F.min("conv_id").alias("conv_id"), F.max("right").alias("right"), F.max("len").alias("longest")).unionByName(top)
    # a node's parent starts at the same rank unless the rank's LCP ends right before the node
    branches = intervals.where("d = lcp").select("rank", F.col("left").alias("_branch"))
    starts = prefixes.select("rank", "block", "lcp", "words").join(branches, "rank", "left").withColumnRenamed("rank", "left")
    members = F.col("right") - F.col("left")
    saved = F.when(F.col("d") == 0, 0).otherwise((members - 1) * F.coalesce(F.get("words", F.col("d") - 1), F.lit(0))).cast("long")
    parent = F.when(F.col("d") - 1 > F.col("lcp"), F.col("left")).when(F.col("d") == 1, 0).otherwise(F.col("_branch"))
    nodes = materialize(
        grouped.join(starts, "left").select("left", "d", "conv_id", "right", members.alias("n_convs"), saved.alias("saved"), (F.col("longest") == F.col("d")).cast("long").alias("leaf"), F.when(F.col("d") > 0, parent).alias("parent")), "nodes",
    )
    sums = ("saved", "leaf")
    by_rank = prefixes.select("rank", "block").join(nodes.groupBy(F.col("left").alias("rank")).agg(*[F.sum(c).alias(c) for c in sums]), "rank", "left").na.fill(0)
    blocks = by_rank.groupBy("block").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    earlier = blocks.select("block", *[(F.sum(f"_{c}").over(Window.orderBy("block")) - F.col(f"_{c}")).alias(f"_{c}") for c in sums])  # one row for each block
    so_far = Window.partitionBy("block").orderBy("rank")
    running = materialize(by_rank.select("rank", "block", *[F.sum(c).over(so_far).alias(c) for c in sums]).join(earlier, "block").select("rank", *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in sums]), "running")
    deeper = Window.partitionBy("left").orderBy(F.desc("d"))
    within = nodes.select("*", *[F.sum(c).over(deeper).alias(f"_{c}") for c in sums])
    upto = lambda side, at: running.select((F.col("rank") + at).alias(side), *[F.col(c).alias(f"{side}_{c}") for c in sums])
    summed = within.join(upto("right", 1), "right").join(upto("left", 0), "left")
    children = nodes.where("d > 0").groupBy(F.col("parent").alias("left"), (F.col("d") - 1).alias("d")).agg(F.count("*").alias("n_children"))
    above = nodes.where("d > 0").select(F.col("left").alias("parent"), (F.col("d") + 1).alias("d"), F.col("conv_id").alias("_above"))
    whole = summed.join(children, ["left", "d"], "left").join(_ends(intervals, prefixes), ["left", "d"], "left").join(above, ["parent", "d"], "left")
    subtree = lambda c: (F.col(f"_{c}") + F.col(f"right_{c}") - F.col(f"left_{c}"))
    return whole.select(
        "conv_id", F.col("d").cast("long").alias("depth"), F.when(F.col("d") == 1, F.lit(root.conv_id)).otherwise(F.col("_above")).cast("long").alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), subtree("leaf").alias("n_leaves"), subtree("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def oracle_sql() -> str:
    """Prefixes as concatenated digests of turns, grouped; subtrees by each node's line of prefixes."""
    return rf"""
    WITH RECURSIVE t AS (
      SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS i
      FROM conversations WHERE conv_id IS NOT NULL),
    crc(conv_id, s, k, x) AS (
      SELECT DISTINCT conv_id, conv_id::VARCHAR, 0, 4294967295::UBIGINT FROM t UNION ALL
      SELECT conv_id, s, k + 1, xor(y >> 1, (y & 1) * 3988292384::UBIGINT)
      FROM (SELECT *, CASE WHEN k % 8 = 0 THEN xor(x, ascii(s[k // 8 + 1])::UBIGINT) ELSE x END AS y FROM crc WHERE k < 8 * length(s))),
    c AS (SELECT conv_id, (xor(x, 4294967295::UBIGINT) % {HEADS})::BIGINT AS h FROM crc WHERE k = 8 * length(s)),
    r AS (SELECT c.conv_id, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % {SHARE} AND i <= h
          UNION ALL SELECT c.conv_id, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND i > h),
    n AS (SELECT conv_id, row_number() OVER w AS d, string_agg(md5(length(role) || ':' || role || text), '') OVER w AS key, len(regexp_extract_all(text, '{WORD}')) AS words,
          count(*) OVER (PARTITION BY conv_id) AS size FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
    p AS (SELECT conv_id, d, key, coalesce(lag(key) OVER (PARTITION BY conv_id ORDER BY d), '') AS above, words, size FROM n
          UNION ALL SELECT c.conv_id, 0, '', NULL, 0, (SELECT count(*) FROM r WHERE r.conv_id = c.conv_id) FROM c),
    node AS (SELECT d, key, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = size), '')) AS ends, bool_and(d = size) AS leaf FROM p GROUP BY d, key),
    under AS (SELECT p.d, p.key, sum(saved) AS saved, count(*) FILTER (WHERE leaf) AS leaves FROM node JOIN p ON p.conv_id = node.conv_id AND p.d <= node.d GROUP BY p.d, p.key),
    kids AS (SELECT d - 1 AS d, above AS key, count(*) AS k FROM node WHERE d > 0 GROUP BY ALL)
    SELECT a.conv_id, a.d::BIGINT AS depth, b.conv_id AS parent_conv_id, a.n_convs::BIGINT AS n_convs, coalesce(k, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
           under.saved::BIGINT AS saved_tokens, a.ends AS ends_sha256
    FROM node a JOIN under ON under.d = a.d AND under.key = a.key LEFT JOIN kids ON kids.d = a.d AND kids.key = a.key LEFT JOIN node b ON a.d > 0 AND b.d = a.d - 1 AND b.key = a.above"""
