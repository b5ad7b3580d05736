"""Approximate nearest neighbours by inner product: NN-descent graph and greedy search (operator 1).

Equal vectors are one node, which keeps its ``EACH`` smallest ids: no answer needs more of them, and a
window limit before the shuffle keeps a very common vector from gathering. A node's list holds the
``NEIGHBOURS`` of smallest angle and the ``NEIGHBOURS`` of largest inner product; where all vectors are as
long, these are the same. Angles make the descent converge, inner products are what is asked for.

Start: random hyperplanes deal nodes into blocks of about ``LEAF`` in ``TABLES`` ways; larger blocks are split
by a hash that differs by table, so a dense group is dealt anew each time. A block lists each member's
nearest members: far too few, as a start. Descent: for every node, neighbours drawn from its list and from
the nodes that list it, new ones first, are joined and compared with one another, pairs of old ones left
out, and each keeps what beats its worst neighbour. Rounds go on until fewer than ``STILL`` of all entries
change. Blocks and neighbourhoods are bounded, so a round is linear in the nodes.

Search: each query starts with its own node's list and expands the nodes among its best ``BEAM`` that it has
not yet, by joins with the graph and the vectors, until all of them are expanded. The graph and the
search use vectors of unit length in half precision and the length beside them, in double precision, so
lengths may differ by any factor; answers are scored from the original vectors in double precision.

Vectors that are null, zero, of another length than most, or that hold null or non-finite components take
no part, nor do rows without id. Rows that share a query's id are its own. An empty table gives no rows.
Ties in score go to the smaller id. Columns beyond the two named are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_path, scratch
from .common import materialize as written

TOP = 20
EACH = TOP + 1
LEAF, TABLES, SEED = 128, 4, 7
NEIGHBOURS, NEAR = 64, 32
#: Share of all list entries; a round that changes fewer is the last.
STILL = 0.01
BEAM = 60
#: Queries up to which their vectors are sent to every task (some 150 bytes each).
BROADCAST_QUERIES = 50_000
LISTS = "node long, ids binary, cos binary, dots binary, new binary, fresh int"
_KINDS = {"ids": np.int64, "cos": np.float32, "dots": np.float64, "new": np.uint8}


def materialize(df: DataFrame, what: str) -> DataFrame:
    """A written table; half-precision vectors don't get smaller by compression, and many small files need no buffers for it."""
    return written(df, what, "uncompressed")


class _Table:
    """A written table that is deleted once its successor is there."""

    def __init__(self, df: DataFrame, what: str):
        self.path = scratch(df.sparkSession, what)
        df.write.option("compression", "uncompressed").parquet(self.path)
        self.df = df.sparkSession.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.df.sparkSession, self.path)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    size = rows.agg(F.mode(F.size("v"), True)).first()[0]
    return rows.where(F.size("v") == (size or 0))


def nodes_of(rows: DataFrame) -> DataFrame:
    """(node, ids, v): distinct vectors, named by their smallest id, with their EACH smallest ids."""
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("rank") <= EACH)
    return first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("node"), "ids", "v")


def scaled(v: pd.Series) -> pd.DataFrame:
    """x: a unit vector in half precision; norm: its length, at most the largest double."""
    raw = np.array(v.tolist(), np.float64).reshape(len(v), -1)
    top = np.abs(raw).max(axis=1, keepdims=True, initial=0)
    unit = raw / np.where(top > 0, top, 1)
    length = np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    with np.errstate(over="ignore"):
        norm = np.minimum(top * length, np.finfo(np.float64).max).ravel()
    half = (unit / np.where(length > 0, length, 1)).astype(np.float16)
    return pd.DataFrame({"x": [r.tobytes() for r in half], "norm": norm})


def _vectors(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float16).reshape(len(blobs), -1).astype(np.float32)


def _dots(cos: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Inner products over the first vector's length."""
    with np.errstate(over="ignore"):
        return cos.astype(np.float64) * norm


def _starts(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else np.zeros(0, int)


def _ranks(groups: np.ndarray) -> np.ndarray:
    """Place of each element in its run of equal values."""
    at = _starts(groups)
    return np.arange(len(groups)) - np.repeat(at, np.diff(np.append(at, len(groups))))


def _lists(node: np.ndarray, sizes: np.ndarray, columns: dict[str, np.ndarray]) -> pd.DataFrame:
    """Rows of LISTS from flat columns, ``sizes`` entries for each node."""
    ends = np.cumsum(sizes)
    out = {"node": node}
    for c, kind in _KINDS.items():
        raw, width = np.ascontiguousarray(columns[c].astype(kind)).tobytes(), np.dtype(kind).itemsize
        out[c] = [raw[(e - n) * width : e * width] for e, n in zip(ends.tolist(), sizes.tolist())]
    return pd.DataFrame(out | {"fresh": [int(np.frombuffer(b, np.uint8).__eq__(2).sum()) for b in out["new"]]}).astype({"node": "int64", "fresh": "int32"})


def _flat(f: pd.DataFrame) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    sizes = f["new"].map(len).to_numpy(int)
    return np.repeat(f["node"].to_numpy(np.int64), sizes), {c: np.frombuffer(b"".join(f[c]), kind) for c, kind in _KINDS.items()}


def _whole_groups(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Frames of rows sorted by ``key``, cut anew so that no key is split."""
    rest = None
    for f in frames:
        f = f if rest is None else pd.concat([rest, f], ignore_index=True)
        last = f[key].iloc[-1] if len(f) else None
        cut = int((f[key] != last).sum()) if len(f) else 0
        if cut:
            yield f.iloc[:cut].reset_index(drop=True)
        rest = f.iloc[cut:]
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True)


def merge(f: pd.DataFrame, keep: int) -> pd.DataFrame:
    """One list for each node: the distinct entries among its ``keep`` best by angle or by inner product."""
    node, c = _flat(f)
    order = np.lexsort((c["new"], c["ids"], node))  # of equal entries the one found first stays
    node, c = node[order], {k: v[order] for k, v in c.items()}
    new = np.append(True, (node[1:] != node[:-1]) | (c["ids"][1:] != c["ids"][:-1])) if len(node) else np.zeros(0, bool)
    node, c = node[new], {k: v[new] for k, v in c.items()}
    best = np.zeros(len(node), bool)
    for by in ("cos", "dots"):
        order = np.lexsort((c["ids"], -c[by], node))
        best[order[_ranks(node[order]) < keep]] = True
    node, c = node[best], {k: v[best] for k, v in c.items()}
    at = _starts(node)
    return _lists(node[at], np.diff(np.append(at, len(node))), c)


def merged(lists: DataFrame, keep: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _whole_groups(frames, "node"):
            yield merge(f, keep)

    return lists.repartition("node").sortWithinPartitions("node").mapInPandas(run, LISTS)


def start_lists(nodes: DataFrame, count: int) -> DataFrame:
    """First lists from blocks of random hyperplanes. nodes: node, x, norm."""
    bits = max(0, math.ceil(math.log2(max(1, count) / LEAF)))
    tables = TABLES if bits else 1

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = _vectors(f["x"].tolist())
            planes = np.random.default_rng(SEED).standard_normal((x.shape[1], max(1, tables * bits))).astype(np.float32)
            side = (x @ planes > 0)[:, : tables * bits].reshape(len(x), tables, bits)
            code = side @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros((len(x), 1), np.int64)
            each = {c: np.repeat(f[c].to_numpy(object if c == "x" else None), tables) for c in ("node", "x", "norm")}
            yield pd.DataFrame({"block": (code + (np.arange(tables, dtype=np.int64) << 40)).ravel(), **each})

    def nearest(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        x, node = _vectors(f["x"].tolist()), f["node"].to_numpy()
        k = min(NEIGHBOURS // 2, len(x) - 1)
        if k < 1:
            return _lists(node[:0], np.zeros(0, int), {c: np.zeros(0) for c in _KINDS})
        cos = x @ x.T
        np.fill_diagonal(cos, -9)
        top = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        sims = np.take_along_axis(cos, top, axis=1).ravel()
        return _lists(node, np.full(len(x), k), {"ids": node[top].ravel(), "cos": sims, "dots": _dots(sims, f["norm"].to_numpy()[top].ravel()), "new": np.full(len(sims), 2)})

    dealt = materialize(nodes.select("node", "x", "norm").mapInPandas(deal, "block long, node long, x binary, norm double"), "dealt")
    large = dealt.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > 3 * LEAF)
    parts = F.coalesce(F.ceil(F.col("n") / F.lit(2 * LEAF)), F.lit(1)).cast("int")
    split = dealt.join(large, "block", "left").withColumn("part", F.pmod(F.xxhash64("node", "block"), parts))
    return split.repartition("block", "part").groupBy("block", "part").applyInPandas(nearest, LISTS)  # else a large block stays in one task


def drawn(node: np.ndarray, ids: np.ndarray, new: np.ndarray, turn: int) -> np.ndarray:
    """Up to NEAR entries of each node's list, new ones first, else by a hash of both nodes and the round."""
    mixed = (ids ^ node ^ np.int64(turn << 32)) * np.int64(-7046029254386353131) >> np.int64(17)
    order = np.lexsort((mixed, new == 0, node))
    out = np.zeros(len(node), bool)
    out[order[_ranks(node[order]) < NEAR]] = True
    return out


def _aged(graph: DataFrame, turn: int) -> DataFrame:
    """Lists whose drawn entries are no longer new; others that are new stay so."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            node, c = _flat(f)
            c["new"] = np.where(drawn(node, c["ids"], c["new"], turn), 0, np.minimum(c["new"], 1))
            yield _lists(f["node"].to_numpy(), f["new"].map(len).to_numpy(int), c)

    return graph.mapInPandas(run, LISTS)


def _near(graph: DataFrame, turn: int) -> DataFrame:
    """(center, member, new): entries drawn from each node's list, and NEAR of the nodes that list it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            node, c = _flat(f)
            yield pd.DataFrame({"center": node, "member": c["ids"], "new": c["new"] > 0, "drawn": drawn(node, c["ids"], c["new"], turn)})

    out = graph.mapInPandas(run, "center long, member long, new boolean, drawn boolean")
    back = out.select(F.col("member").alias("center"), F.col("center").alias("member"), "new")
    by = Window.partitionBy("center").orderBy(F.col("new").desc(), F.xxhash64("center", "member", F.lit(turn)), "member")
    some = back.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= NEAR).drop("rank")
    return out.where("drawn").select("center", "member", "new").unionByName(some).groupBy("center", "member").agg(F.max("new").alias("new"))


def found_in(new: np.ndarray, x: np.ndarray, norm: np.ndarray, worst_cos: np.ndarray, worst_dot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cos, dot) of the ordered pairs of a neighbourhood, one of them new, that beat i's worst neighbour."""
    cos = x @ x.T
    dot = _dots(cos, norm[None, :])
    better = ((cos > worst_cos[:, None]) | (dot > worst_dot[:, None])) & (new[:, None] | new[None, :])
    np.fill_diagonal(better, False)
    i, j = np.nonzero(better)
    return i, j, cos[i, j], dot[i, j]


def descend(graph: DataFrame, nodes: DataFrame, turn: int) -> DataFrame:
    """One round: lists of what the members of each neighbourhood find in one another."""

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _whole_groups(frames, "center"):
            center, member, x = f["center"].to_numpy(), f["member"].to_numpy(), _vectors(f["x"].tolist())
            new, norm, worst = f["new"].to_numpy(bool), f["norm"].to_numpy(), (f["worst_cos"].to_numpy(), f["worst_dot"].to_numpy())
            at = _starts(center)
            got = []
            for a, b in zip(at, np.append(at[1:], len(center))):
                i, j, cos, dot = found_in(new[a:b], x[a:b], norm[a:b], worst[0][a:b], worst[1][a:b])
                got.append((member[a:b][i], member[a:b][j], cos, dot))
            node, ids, cos, dots = (np.concatenate(p) for p in zip(*got))
            order = np.lexsort((ids, node))
            node, ids, cos, dots = node[order], ids[order], cos[order], dots[order]
            first = np.append(True, (node[1:] != node[:-1]) | (ids[1:] != ids[:-1])) if len(node) else np.zeros(0, bool)
            node, ids, cos, dots = node[first], ids[first], cos[first], dots[first]
            starts = _starts(node)
            yield _lists(node[starts], np.diff(np.append(starts, len(node))), {"ids": ids, "cos": cos, "dots": dots, "new": np.full(len(ids), 2)})

    @F.pandas_udf("worst_cos double, worst_dot double")
    def worst(cos: pd.Series, dots: pd.Series) -> pd.DataFrame:
        last = lambda blobs, kind: [float(-np.partition(-x, NEIGHBOURS - 1)[NEIGHBOURS - 1]) if len(x := np.frombuffer(b, kind)) >= NEIGHBOURS else -math.inf for b in blobs]
        return pd.DataFrame({"worst_cos": last(cos, np.float32), "worst_dot": last(dots, np.float64)})

    known = nodes.select("node", "x", "norm").join(graph.select("node", worst("cos", "dots").alias("w")).select("node", "w.*"), "node").withColumnRenamed("node", "member")
    members = _near(graph, turn).join(known, "member")
    return members.repartition("center").sortWithinPartitions("center").mapInPandas(join, LISTS)


def build(nodes: DataFrame, count: int, told: Callable[[int, DataFrame], None] | None = None) -> DataFrame:
    """The neighbour graph (LISTS). ``told`` gets the number of each round, 0 for the start, and its graph."""
    now, turn = _Table(merged(start_lists(nodes, count), NEIGHBOURS), "graph"), 0
    while True:
        if told:
            told(turn, now.df)
        fresh, size = now.df.agg(F.coalesce(F.sum("fresh"), F.lit(0)), F.coalesce(F.sum(F.octet_length("new")), F.lit(0))).first()
        if turn and fresh <= STILL * size:
            return now.df
        after = _Table(merged(_aged(now.df, turn).unionByName(descend(now.df, nodes, turn)), NEIGHBOURS), "graph")
        now.drop()
        now, turn = after, turn + 1


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)


POOL = "q long, ids binary, scores binary, done binary, open int"


def pooled(f: pd.DataFrame, keep: int) -> pd.DataFrame:
    """One pool for each query: the ``keep`` best distinct nodes, and which of them have been expanded."""
    sizes = f["done"].map(len).to_numpy(int)
    q = np.repeat(f["q"].to_numpy(np.int64), sizes)
    ids, scores, done = (np.frombuffer(b"".join(f[c]), kind) for c, kind in (("ids", np.int64), ("scores", np.float64), ("done", np.uint8)))
    order = np.lexsort((1 - done.astype(int), ids, q))
    q, ids, scores, done = q[order], ids[order], scores[order], done[order]
    first = np.append(True, (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])) if len(q) else np.zeros(0, bool)
    q, ids, scores, done = q[first], ids[first], scores[first], done[first]
    order = np.lexsort((ids, -scores, q))
    order = order[_ranks(q[order]) < keep]
    q, ids, scores, done = q[order], ids[order], scores[order], done[order]
    at = _starts(q)
    cut = lambda x: [x[a:b].tobytes() for a, b in zip(at, np.append(at[1:], len(q)))]
    return pd.DataFrame({"q": q[at], "ids": cut(ids), "scores": cut(scores), "done": cut(done), "open": np.add.reduceat((done == 0).astype(np.int32), at) if len(at) else np.zeros(0, np.int32)})


def search(queries: DataFrame, graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """(q, ids, scores, done, open): each query's BEAM best nodes, all expanded. queries: q (its node), xq."""
    near = graph.select("node", "ids")
    small = F.broadcast(queries) if queries.count() <= BROADCAST_QUERIES else queries

    def begin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pooled(pd.DataFrame({"q": f["node"], "ids": f["ids"], "scores": f["dots"], "done": [b"\0" * len(b) for b in f["new"]]}), BEAM)

    def alone(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"q": f["q"], "ids": [np.int64(q).tobytes() for q in f["q"]], "scores": [np.float64(n).tobytes() for n in f["norm"]], "done": [b"\1"] * len(f), "open": 0}).astype({"open": "int32"})

    def expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            todo = [np.frombuffer(i, np.int64)[np.frombuffer(d, np.uint8) == 0] for i, d in zip(f["ids"], f["done"])]
            worst = [float(np.frombuffer(s, np.float64).min()) if len(s) == 8 * BEAM else -math.inf for s in f["scores"]]
            if todo:
                sizes = [len(x) for x in todo]
                yield pd.DataFrame({"q": np.repeat(f["q"].to_numpy(), sizes), "node": np.concatenate(todo), "worst": np.repeat(np.array(worst), sizes)})

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids = [np.frombuffer(b, np.int64) for b in f["ids"]]
            if ids:
                sizes = [len(x) for x in ids]
                yield pd.DataFrame({"q": np.repeat(f["q"].to_numpy(), sizes), "node": np.concatenate(ids), "worst": np.repeat(f["worst"].to_numpy(), sizes)})

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                dots = _dots((_vectors(f["xq"].tolist()) * _vectors(f["x"].tolist())).sum(axis=1), f["norm"].to_numpy())
                good = dots > f["worst"].to_numpy()  # others would not get into the pool
                q, node, dots = f["q"].to_numpy()[good], f["node"].to_numpy(np.int64)[good], dots[good]
                yield pooled(pd.DataFrame({"q": q, "ids": [x.tobytes() for x in node], "scores": [x.tobytes() for x in dots], "done": [b"\0"] * len(q)}), BEAM)

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _whole_groups(frames, "q"):
            yield pooled(f, BEAM)

    def closed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(done=[b"\1" * len(b) for b in f["done"]], open=np.zeros(len(f), np.int32))

    own = queries.select(F.col("q").alias("node")).join(graph, "node").mapInPandas(begin, POOL)
    itself = queries.select("q").join(nodes.select(F.col("node").alias("q"), "norm"), "q").mapInPandas(alone, POOL)
    pool = _Table(own.unionByName(itself).repartition("q").sortWithinPartitions("q").mapInPandas(gather, POOL), "pool")
    while pool.df.agg(F.coalesce(F.sum("open"), F.lit(0))).first()[0]:
        front = pool.df.where("open > 0").mapInPandas(expand, "q long, node long, worst double")
        met = front.join(near, "node").select("q", "ids", "worst").mapInPandas(listed, "q long, node long, worst double").distinct()
        fresh = met.join(nodes.select("node", "x", "norm"), "node").join(small, "q").mapInPandas(scored, POOL)
        after = _Table(pool.df.mapInPandas(closed, POOL).unionByName(fresh).repartition("q").sortWithinPartitions("q").mapInPandas(gather, POOL), "pool")
        pool.drop()
        pool = after
    return pool.df


def nearest(df: DataFrame, id_col: str, vec_col: str, is_query: Column, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` (over ``vec_id``), its ``top`` nearest others found."""
    rows = materialize(usable(df, id_col, vec_col), "vectors")
    half = F.pandas_udf(scaled, "x binary, norm double")
    nodes = materialize(nodes_of(rows).select("node", "ids", "v", half("v").alias("h")).select("node", "ids", "v", "h.*"), "nodes")
    graph = build(nodes, nodes.count())
    asked = materialize(rows.where(is_query).select("vec_id", "v").join(nodes.select("node", "v"), "v").select(F.col("vec_id").alias("query_id"), F.col("node").alias("q")).distinct(), "asked")
    starts = materialize(asked.select(F.col("q").alias("node")).distinct().join(nodes.select("node", "v", "x"), "node").select(F.col("node").alias("q"), "v", F.col("x").alias("xq")), "starts")

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids = [np.frombuffer(b, np.int64) for b in f["ids"]]
            if ids:
                yield pd.DataFrame({"q": np.repeat(f["q"].to_numpy(), [len(x) for x in ids]), "node": np.concatenate(ids)})

    met = search(starts.select("q", "xq"), graph, nodes).mapInPandas(spread, "q long, node long")
    found = met.join(nodes.select("node", F.col("v").alias("w")), "node").join(starts.select("q", "v"), "q").select("q", "node", _dot("v", "w").alias("score"))
    # one node of the list may be the query's own alone, so one more is kept; then its ids, nearest first
    by_q = Window.partitionBy("q")
    best = found.withColumn("rank", F.row_number().over(by_q.orderBy(F.col("score").desc(), "node"))).where(F.col("rank") <= top + 1).drop("rank")
    each = best.join(nodes.select("node", "ids"), "node").select("q", "score", F.explode("ids").alias("vec_id"))
    firsts = each.withColumn("rank", F.row_number().over(by_q.orderBy(F.col("score").desc(), "vec_id"))).where(F.col("rank") <= top + 1).drop("rank")
    answers = asked.join(firsts, "q").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return answers.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= top)
