"""SimHash near-duplicates with pigeonring filtering (operator 7).

Fingerprints are 64 bits over word shingles. Two texts link at ``BUDGET`` or fewer differing bits.
The fingerprint is cut into a ring of four 16-bit segments. If two fingerprints differ in at most 3
bits, some start segment exists from which every chain of l consecutive segments differs in at most
floor(3 l / 4) bits in sum: 0 for one segment, 1 for two, 2 for three, 3 for all four. Candidates are
found by an equi-join on chains of two (16 bits equal, the next 16 equal but for one bit), filtered by
the chain of three, then by the full Hamming distance. Keys have 32 bits, so a bucket grows as
n / 2^32; the 17 spellings of the second segment are enumerated on one side only.

Equal fingerprints are one row before any join. Buckets with more than ``HEAVY`` members are cut into
square blocks which emit a spanning forest instead of pairs, so no dense group is expanded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components

BUDGET = 3
SEGMENT = 16
#: Base members of one chain key up to which pairs are joined; beyond it they are compared in blocks.
HEAVY = 64
BLOCK = 2048
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit fingerprint. No word, empty or null: zero. Fewer words than a shingle: one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    parts = [words[k:] for k in range(shingle)] if len(words) >= shingle else [[w] for w in [b" ".join(words)]]
    total = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    hashes = np.fromiter((digest(s, 42) for s in map(b" ".join, zip(*parts))), np.uint64, total)
    for at in range(0, total, CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """Arrow-batched fingerprint column (long)."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, shingle) for t in texts], dtype="int64")

    return fp(text)


def _chains(fps: DataFrame) -> DataFrame:
    """(key, fp, base): the chain keys of two segments for each start, with at most one flipped bit in the second."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(SEGMENT)])
    rot = F.array(*[
        F.struct(F.lit(i).cast("long").alias("i"), (F.col("fp") if i == 0 else F.shiftleft("fp", SEGMENT * i).bitwiseOR(F.shiftrightunsigned("fp", 64 - SEGMENT * i))).alias("r"))
        for i in range(4)
    ])
    start = fps.select("fp", F.explode(rot).alias("s")).select("fp", F.col("s.i").alias("i"), F.shiftrightunsigned("s.r", 32).alias("top"))
    return start.select("fp", "i", "top", F.explode(flips).alias("flip")).select(
        F.shiftleft("i", 32).bitwiseOR(F.col("top").bitwiseXOR(F.col("flip"))).alias("key"), "fp", (F.col("flip") == 0).alias("base")
    )


def _third(key: Column, diff: Column) -> Column:
    """Bits that differ in the chain of three segments from the key's start."""
    every = (1 << 64) - 1
    left_out = [((0xFFFF << (SEGMENT * ((4 - i) % 4))) & every) for i in range(4)]
    masks = [every ^ m for m in left_out]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    start = F.shiftrightunsigned(key, 32)
    mask = F.when(start == 0, F.lit(signed[0])).when(start == 1, F.lit(signed[1])).when(start == 2, F.lit(signed[2])).otherwise(F.lit(signed[3]))
    return F.bit_count(diff.bitwiseAND(mask))


def ring(diff: Column, budget: int) -> Column:
    """Whether two fingerprints with the differing bits ``diff`` pass the pigeonring and the Hamming check: from some
    segment on, every chain of l of the four differs in at most l budget / 4 bits, and all in at most ``budget``."""
    parts = [F.bit_count(F.shiftrightunsigned(diff, SEGMENT * i).bitwiseAND(F.lit((1 << SEGMENT) - 1))) for i in range(4)]
    chains = [[sum(parts[(i + k) % 4] for k in range(1, n)) + parts[i] <= n * budget // 4 for n in range(1, 5)] for i in range(4)]
    started = [a & b & c for a, b, c, _ in chains]
    return (started[0] | started[1] | started[2] | started[3]) & (F.bit_count(diff) <= budget)


def forest(fp: np.ndarray, base: np.ndarray, other: np.ndarray, budget: int = BUDGET) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between two lists of fingerprints."""
    at = {int(x): int(x) for x in np.concatenate([base, other])}

    def root(x: int) -> int:
        while at[x] != x:
            at[x] = x = at[at[x]]
        return x

    out = []
    b, o = base.view(np.uint64), other.view(np.uint64)
    for i in range(len(b)):
        for j in np.flatnonzero(np.bitwise_count(o ^ b[i]) <= budget):
            p, q = root(int(base[i])), root(int(other[j]))
            if p != q:
                at[max(p, q)] = min(p, q)
                out.append((int(base[i]), int(other[j])))
    return out


def _heavy_edges(rows: DataFrame) -> DataFrame:
    """rows: key, n (base members), fp, base. Squares of at most BLOCK fingerprints a side."""
    slot = rows.withColumn("nb", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")).withColumn("blk", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))
    spread = F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("x")
    left = slot.where("base").select("key", "blk", spread, "fp").select("key", F.col("blk").alias("p"), F.col("x").alias("q"), "fp", F.lit(True).alias("base"))
    right = slot.select("key", "blk", spread, "fp").select("key", F.col("x").alias("p"), F.col("blk").alias("q"), "fp", F.lit(False).alias("base"))

    def square(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, base = pdf["fp"].to_numpy(np.int64), pdf["base"].to_numpy(bool)
        return pd.DataFrame(forest(fp, np.unique(fp[base]), np.unique(fp[~base])), columns=["a", "b"], dtype="int64")

    return left.unionByName(right).groupBy("key", "p", "q").applyInPandas(square, "a long, b long")


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints, or a spanning forest of them in dense buckets."""
    rows = _chains(fps)
    heavy = materialize(rows.where("base").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY), "heavy")
    dense = not heavy.isEmpty()
    light = rows.join(heavy, "key", "left_anti") if dense else rows
    base = light.where("base").select("key", F.col("fp").alias("b"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    pairs = (
        light.select("key", F.col("fp").alias("a")).join(base.hint("shuffle_hash"), "key")
        .where((F.col("a") != F.col("b")) & (_third(F.col("key"), diff) <= 2) & (F.bit_count(diff) <= BUDGET))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    return pairs.unionByName(_heavy_edges(rows.join(heavy, "key"))) if dense else pairs


def near_duplicates(prints: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``prints`` (id, fp) with component_id: the smallest id among all rows reachable over links.

    A null id is never the smallest; a component of null ids alone has a null component_id. Repeated
    rows stay. ``prints`` is read several times: pass a written table.
    """
    reps = prints.groupBy("fp").agg(F.min(id_col).alias("rep"))
    nodes = components(materialize(links(reps.select("fp")), "links"))
    moved = nodes.join(reps, nodes["node"] == reps["fp"]).select("fp", "root", "rep")
    low = moved.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = moved.join(low, "root").select("fp", "component_id")
    ids = reps.join(named, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    return prints.join(materialize(ids, "ids"), "fp")  # read anew, so that a common fingerprint's rows can be split


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) of every row.

    Null and empty texts have fingerprint zero and link like any other. An empty table gives no rows.
    """
    prints = materialize(df.select(F.col(id_col), fingerprint(F.col(text_col), shingle).alias("fp")), "prints")
    return near_duplicates(prints, id_col).select(id_col, hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``df`` with one row of each component: that of the smallest id (nulls last), of repeated ones the first stored.

    Rows are numbered in a written copy, so that equal rows and null ids can be told apart.
    """
    columns = df.columns
    own = {c: f"_c{i}" for i, c in enumerate(columns)}
    rows = df.select(*[F.col(f"`{c}`").alias(own[c]) for c in columns])
    numbered = materialize(rows.select("*", fingerprint(F.col(own[text_col]), shingle).alias("fp"), F.monotonically_increasing_id().alias("row_no")), "numbered")
    prints = numbered.select(F.col(own[id_col]).alias("id"), "fp", "row_no")
    reps = prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_no")).alias("first"))
    nodes = components(materialize(links(reps.select("fp")), "links"))
    group = reps.join(nodes, reps["fp"] == nodes["node"], "left").groupBy(F.coalesce("root", "fp").alias("g"))
    first = group.agg(F.min("first").alias("first")).select(F.col("first.row_no").alias("row_no"))
    return numbered.join(first, "row_no", "left_semi").select(*[F.col(own[c]).alias(c) for c in columns])
