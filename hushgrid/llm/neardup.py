"""SimHash near-duplicates by Jaccard similarity of word shingles, for the pipeline's stage (operator 7).

Two texts link if their sets of ``SHINGLE``-word shingles have Jaccard similarity ``LEAST`` or more. Three bits of a
fingerprint, as ``simhash`` links them, find few such pairs, so more bits may differ here and shared shingles
name the candidates: sets of n shingles that are similar enough share one among the first n - ceil(LEAST n) + 1 of
each in any common order, so a join on these prefixes misses no pair. Candidates pass the pigeonring chains and
the full Hamming check at ``BUDGET`` bits, then sketches, then the whole sets decide. Sets of under ``FEW`` shingles have too
coarse fingerprints and skip to the sketches. The order is by hash, common shingles last: it decides on the work, not
on the result. A sketch has about a bit for each shingle, the parity of those that fall on it: two sets have at least as
many shingles apart as their sketches have bits, so those that are too far apart by them need not be read whole.

Equal sets are one node before any join. Each node is first compared with one centre of each of its shingles: the
node whose shingles are most shared, as the text that others were copied from. Then only nodes in different
components so far are compared: pairs of a rare shingle by a join, those of shingles of more than ``HEAVY`` nodes
by the centre of these shingles, in square blocks, which give links between components instead of pairs. A block gets the
whole sets of those nodes alone whose common shingles, sizes and sketches leave a similar one of another component possible.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_path, materialize, scratch, small_batches, written
from .components import components
from .simhash import CHUNK, ring

SHINGLE, LEAST = 5, Fraction(4, 5)
#: Shingles found more often than this, as counted within ``AT_ONCE`` texts each, are moved to the end of the order; the most common ``MOST`` at most.
COMMON, AT_ONCE, MOST = 64, 1000, 200_000
#: Bits of 64 in which fingerprints may differ (two sets of similarity 0.8 differ in 10, seldom in 20), and sets they aren't used for.
BUDGET, FEW = 28, 32
#: Nodes of a shingle up to which pairs are joined; nodes and shingles of a block beyond that.
HEAVY, BLOCK, BLOCK_SHINGLES = 32, 1024, 4_000_000
#: Nodes up to which a list of them is sent to every task.
BROADCAST_NODES = 300_000


class _Temporary:
    """Written tables that go together once nothing reads them any more."""

    def __init__(self):
        self.paths: list[tuple] = []

    def table(self, df: DataFrame, what: str) -> DataFrame:
        path = scratch(df.sparkSession, what)
        df.write.parquet(path)
        self.paths.append((df.sparkSession, path))
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        while self.paths:
            drop_path(*self.paths.pop())


def shingles_of(text: str | None) -> np.ndarray:
    """Sorted distinct hashes. No word: none. Fewer words than a shingle: one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = [words[k:] for k in range(SHINGLE)] if len(words) >= SHINGLE else [[w] for w in [b" ".join(words)]]
    total = max(1, len(words) - SHINGLE + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in map(b" ".join, zip(*parts))), np.uint64, total))


def prefix_of(h: np.ndarray, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles by which any set of enough similarity is met, and the count of each that is common (0: it isn't)."""
    many = np.zeros(len(h), np.int32)
    if len(common) and len(h):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        many = np.where(common[at] == h, counts[at], 0)
        order = np.argsort(many > 0, kind="stable")
        h, many = h[order], many[order]
    n = len(h) - -(-LEAST.numerator * len(h) // LEAST.denominator) + 1
    return h[:n], many[:n]


def fingerprint_of(h: np.ndarray) -> int:
    """Signed 64 bits: those set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), CHUNK):
        counts += np.unpackbits(h[at : at + CHUNK].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.int64)[0])


def sketch_of(h: np.ndarray) -> bytes:
    """The parity of how many hashes fall on each of 64 bits or more, a power of two, at least as many as hashes."""
    bits = 1 << max(6, (len(h) - 1).bit_length())
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def may_be_similar(x: bytes, y: bytes, total: int) -> bool:
    """Whether sets of ``total`` hashes together may be similar by their sketches: differing bits are hashes that one set alone has, at least."""
    a, b = (np.frombuffer(s, np.uint64) for s in (x, y))
    while len(a) > len(b):  # the bits that a smaller sketch would put together
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum()) * (LEAST.numerator + LEAST.denominator) <= (LEAST.denominator - LEAST.numerator) * total


def _digest(text: Column) -> Column:
    """Digest, size n, fingerprint and sketch of the set."""

    @F.pandas_udf("digest binary, n long, fp long, sketch binary")
    def run(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles_of(t) for t in texts]
        return pd.DataFrame({"digest": [xxhash.xxh3_128_digest(h.tobytes()) for h in sets], "n": [len(h) for h in sets], "fp": [fingerprint_of(h) for h in sets], "sketch": [sketch_of(h) for h in sets]})

    return run(text)


def _enough(shared: str, a: str, b: str) -> Column:
    """Whether sets of sizes a and b can be similar whose prefixes share so many: others they share lie behind the prefix that ends first."""
    t, u = LEAST.numerator, LEAST.denominator
    behind = lambda n: f"(({t} * {n} + {u - 1}) div {u} - 1)"
    return F.expr(f"{u} * least({a}, {b}) >= {t} * greatest({a}, {b}) and {t + u} * ({shared} + greatest({behind(a)}, {behind(b)})) >= {t} * ({a} + {b})")


def _close(a: str, b: str, na: str, nb: str) -> Column:
    return (F.least(na, nb) < FEW) | ring(F.col(a).bitwiseXOR(F.col(b)), BUDGET)


def _tokens(numbered: DataFrame, text: str, temp: _Temporary) -> DataFrame:
    """(node, token, many, share): each row's prefix, where shared; how many have the shingle, and 1 / the prefix's length."""
    common, counts = _common(numbered, text)

    @F.pandas_udf("token array<long>, many array<int>, share float")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [prefix_of(shingles_of(t), common, counts) for t in texts]
        return pd.DataFrame({"token": [h.view(np.int64) for h, _ in found], "many": [n.astype(np.int32) for _, n in found], "share": [1 / max(1, len(h)) for h, _ in found]})

    sets = numbered.select(F.col("row_no").alias("node"), run(F.col(text)).alias("p"))
    each = sets.select("node", "p.share", F.explode(F.arrays_zip("p.token", "p.many")).alias("t")).select("node", "t.token", "t.many", "share")
    # common shingles are left out of the window, in which all nodes of one meet
    alone = F.when(F.col("many") > 0, F.xxhash64("node")).otherwise(F.lit(0))
    met = F.count("*").over(Window.partitionBy("token", alone)).cast("int")
    return temp.table(each.withColumn("many", F.greatest("many", met)).where("many > 1"), "tokens")


def _common(numbered: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common, sorted, and their counts. Only those that repeat within some texts read at once are shuffled."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), AT_ONCE):
                token, n = np.unique(np.concatenate([shingles_of(t) for t in f[text].iloc[at : at + AT_ONCE]]), return_counts=True)
                yield pd.DataFrame({"token": token[n > 1].view(np.int64), "n": n[n > 1].astype(np.int64)})

    counts = numbered.select(text).mapInPandas(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") > COMMON).orderBy(F.col("n").desc(), "token").limit(MOST).collect()
    token, n = np.array([r.token for r in found], np.int64).view(np.uint64), np.array([min(r.n, (1 << 31) - 1) for r in found], np.int32)
    order = np.argsort(token)
    return token[order], n[order]


def _sets(ids: DataFrame, numbered: DataFrame, text: str, temp: _Temporary) -> DataFrame:
    """(row_no, h): the whole sets of some rows. ``ids`` (row_no) is read twice: pass a written table."""
    small = F.broadcast(ids) if ids.count() <= BROADCAST_NODES else ids

    @F.pandas_udf("binary")
    def whole(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles_of(t).tobytes() for t in texts], dtype=object)

    return temp.table(numbered.join(small, "row_no", "left_semi").select("row_no", whole(F.col(text)).alias("h")), "sets")


def _drawn(ids: DataFrame, sketches: DataFrame) -> DataFrame:
    """(row_no, n, sketch) of some rows. ``ids`` (row_no) is read twice: pass a written table."""
    small = F.broadcast(ids) if ids.count() <= BROADCAST_NODES else ids
    return sketches.join(small, "row_no", "left_semi")


def _of_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("row_no")).unionByName(pairs.select(F.col("b").alias("row_no"))).distinct()


def _possible(pairs: DataFrame, sketches: DataFrame, temp: _Temporary) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets may be similar by their sketches. ``pairs`` is read twice: pass a written table."""

    @F.pandas_udf("boolean")
    def possible(x: pd.Series, y: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series([may_be_similar(*each) for each in zip(x, y, total)], dtype=bool)

    drawn = temp.table(_drawn(temp.table(_of_pairs(pairs), "drawn"), sketches), "sketches")
    left = pairs.join(drawn.select(F.col("row_no").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x")), "a")
    both = left.join(drawn.select(F.col("row_no").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y")), "b")
    return both.where(possible("x", "y", F.col("na") + F.col("nb"))).select("a", "b")


def _similar(pairs: DataFrame, numbered: DataFrame, text: str, temp: _Temporary) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets are similar. ``pairs`` is read twice: pass a written table."""

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both * LEAST.denominator >= (len(p) + len(q) - both) * LEAST.numerator)
        return pd.Series(out, dtype=bool)

    sets = _sets(temp.table(_of_pairs(pairs), "compared"), numbered, text, temp)
    left = pairs.join(sets.select(F.col("row_no").alias("a"), F.col("h").alias("x")), "a")
    both = left.join(sets.select(F.col("row_no").alias("b"), F.col("h").alias("y")), "b")
    return both.where(alike("x", "y")).select("a", "b")


def hopeful(g: np.ndarray, n: np.ndarray, marks: list[np.ndarray], sketches: list[bytes] | None = None) -> np.ndarray:
    """Which nodes of a block may be similar to one of another component: sizes n and the common shingles of their prefixes, ``marks``,
    pass the bound of ``_enough``, and the sketches, if given, that of ``may_be_similar``. Pairs that share rarer ones too are joined elsewhere. Nodes of the largest component aren't looked up."""
    _, group = np.unique(g, return_inverse=True)
    sizes = np.array([len(m) for m in marks])
    tokens, owner = np.concatenate(marks), np.repeat(np.arange(len(marks)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    t, u = LEAST.numerator, LEAST.denominator
    behind = -(-t * n // u) - 1
    out = np.zeros(len(n), bool)
    for i in np.flatnonzero(group != np.bincount(group).argmax()):
        lo, hi = np.searchsorted(tokens, marks[i], "left"), np.searchsorted(tokens, marks[i], "right")
        lengths = hi - lo
        places = np.repeat(lo - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
        both = np.bincount(owner[places], minlength=len(n))
        fits = (u * np.minimum(n, n[i]) >= t * np.maximum(n, n[i])) & ((t + u) * (both + np.maximum(behind, behind[i])) >= t * (n + n[i]))
        found = (both > 0) & fits & (group != group[i])
        if sketches is not None:
            for j in np.flatnonzero(found):
                found[j] = may_be_similar(sketches[i], sketches[j], int(n[i] + n[j]))
        if found.any():
            out[i] = True
            out |= found
    return out


def bridges(node: np.ndarray, g: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between components g: enough of them to join all that similar pairs join. Nodes of the largest one aren't looked up."""
    names, group = np.unique(g, return_inverse=True)
    at = np.arange(len(names))

    def root(x: int) -> int:
        while at[x] != x:
            at[x] = x = at[at[x]]
        return x

    sizes = np.array([len(s) for s in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    out = []
    for i in np.flatnonzero(group != np.bincount(group).argmax()):
        lo, hi = np.searchsorted(tokens, sets[i], "left"), np.searchsorted(tokens, sets[i], "right")
        lengths = hi - lo
        places = np.repeat(lo - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
        both = np.bincount(owner[places], minlength=len(sets))
        for j in np.flatnonzero(both * LEAST.denominator >= (sizes + sizes[i] - both) * LEAST.numerator):
            p, q = root(group[i]), root(group[j])
            if p != q:
                at[max(p, q)] = min(p, q)
                out.append((int(node[i]), int(node[j])))
    return out


def _bridged(rows: DataFrame, marks: DataFrame, sketches: DataFrame, numbered: DataFrame, text: str, temp: _Temporary) -> DataFrame:
    """rows: token, node, n, g, where token names what nodes share; marks: node and its common shingles; sketches: of all rows. (a, b): links between components, from square blocks of each."""
    size = rows.groupBy("token").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int").alias("nb"))
    own = F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")
    each = rows.join(size, "token").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    squares = each.select("token", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "node", "n", "g")

    def chosen(f: pd.DataFrame) -> pd.DataFrame:
        sketches = f["sketch"].tolist() if "sketch" in f else None
        return f[hopeful(f["g"].to_numpy(), f["n"].to_numpy(), [np.asarray(m, np.int64) for m in f["marks"]], sketches)][["token", "p", "q", "node", "n", "g"]]

    def those(df: DataFrame) -> DataFrame:
        return temp.table(df.join(marks, "node").groupBy("token", "p", "q").applyInPandas(chosen, "token long, p int, q int, node long, n long, g long"), "hopeful")

    first = those(squares)  # sketches go to the few that are left only
    drawn = _drawn(temp.table(first.select(F.col("node").alias("row_no")).distinct(), "drawn"), sketches)
    placed = those(first.join(drawn.select(F.col("row_no").alias("node"), "sketch"), "node")).withColumnRenamed("node", "row_no")
    ids = temp.table(placed.select("row_no").distinct(), "compared")

    def square(f: pd.DataFrame) -> pd.DataFrame:
        found = bridges(f["row_no"].to_numpy(), f["g"].to_numpy(), [np.frombuffer(h, np.uint64) for h in f["h"]])
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return placed.join(_sets(ids, numbered, text, temp), "row_no").groupBy("token", "p", "q").applyInPandas(square, "a long, b long")


def links(numbered: DataFrame, nodes: DataFrame, sketches: DataFrame, text: str) -> DataFrame:
    """(a, b): links that join the same nodes as all similar pairs do. numbered: row_no, text; nodes: node, n, fp of the rows to compare; sketches: row_no, n, sketch."""
    temp = _Temporary()
    small = F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes
    tokens = _tokens(numbered.join(small.select(F.col("node").alias("row_no")), "row_no", "left_semi"), text, temp)

    def kept(pairs: DataFrame, what: str) -> DataFrame:
        """The similar ones of (a, b, c): c shared shingles of the prefixes at least."""
        sized = pairs.join(small.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("fp").alias("fa")), "a").join(small.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("fp").alias("fb")), "b")
        near = sized.where(_enough("c", "na", "nb") & _close("fa", "fb", "na", "nb")).select("a", "b")
        possible = temp.table(_possible(temp.table(near, what), sketches, temp), "possible")
        return materialize(_similar(possible, numbered, text, temp), "links")

    known = tokens.groupBy("node").agg(F.sum(F.col("many") * F.col("share")).alias("known"))
    centres = temp.table(tokens.select("token", "node").join(known, "node").groupBy("token").agg(F.max(F.struct("known", "node")).alias("c")).select("token", F.col("c.node").alias("b")), "centres")
    stars = tokens.select("token", F.col("node").alias("a")).join(centres, "token").where("a != b").groupBy("a", "b").agg(F.count("*").alias("c"))
    first = kept(stars, "stars")
    roots = temp.table(components(first), "roots")
    grouped = tokens.select("token", "node", "many").join(roots, "node", "left").select("token", "node", "many", F.coalesce("root", "node").alias("g"))
    mixed = grouped.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo != hi").select("token")
    rest = temp.table(grouped.join(mixed, "token"), "mixed")
    common = rest.groupBy("node").agg(F.count_if(F.col("many") > HEAVY).alias("common"))
    light = temp.table(rest.where(F.col("many") <= HEAVY).join(common, "node").select("token", "node", "g", "common"), "light")
    a, b = light.alias("a"), light.alias("b")
    # common shingles that a pair shares aren't counted by this join, so as many as it can share are added
    met = (
        a.join(b, F.expr("a.token = b.token and a.g < b.g")).groupBy(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
        .agg((F.count("*") + F.least(F.first("a.common"), F.first("b.common"))).alias("c"))
    )
    out = first.unionByName(kept(met, "pairs"))
    # nodes that share a common shingle also share its centre, and copies of one text have one centre for nearly all of theirs
    shared = rest.where(F.col("many") > HEAVY)
    heavy = temp.table(shared.join(centres, "token").select(F.col("b").alias("token"), "node", "g").distinct(), "heavy")
    if not heavy.isEmpty():
        marks = temp.table(shared.groupBy("node").agg(F.collect_list("token").alias("marks")), "marks")
        out = out.unionByName(materialize(_bridged(heavy.join(small.select("node", "n"), "node"), marks, sketches, numbered, text, temp), "links"))
    temp.drop()
    return out


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each component: that of the smallest id (nulls last), of repeated ones the first stored.

    Null and empty texts have no shingle and are equal; very long ones count whole. Rows are numbered in a written copy, so that
    equal rows and null ids can be told apart. Texts go to Python in small Arrow batches, in a session of their own.
    """
    spark = df.sparkSession
    own = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()]).withColumn("row_no", F.monotonically_increasing_id())
    path = written(rows, "numbered")
    numbered = small_batches(spark).read.schema(rows.schema).parquet(path)
    sets = materialize(numbered.select(own[id_col], "row_no", _digest(F.col(own[text_col])).alias("set")).select(own[id_col], "row_no", "set.*"), "digests")
    first = F.min(F.struct(F.col(own[id_col]).isNull().alias("none"), F.col(own[id_col]).alias("id"), "row_no")).alias("first")
    reps = materialize(sets.groupBy("digest").agg(first, F.min("row_no").alias("node"), F.first("n").alias("n"), F.first("fp").alias("fp")), "reps")
    found = components(links(numbered.select("row_no", own[text_col]), reps.select("node", "n", "fp"), sets.select("row_no", "n", "sketch"), own[text_col]))
    group = reps.join(found, "node", "left").groupBy(F.coalesce("root", "node").alias("g")).agg(F.min("first").alias("first"))
    kept = written(group.select(F.col("first.row_no").alias("row_no")), "kept")
    stored = spark.read.schema(rows.schema).parquet(path)
    return stored.join(spark.read.schema("row_no long").parquet(kept), "row_no", "left_semi").select(*[F.col(n).alias(c) for c, n in own.items()])
