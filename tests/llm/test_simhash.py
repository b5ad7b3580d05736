import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from hushgrid.llm import simhash
from hushgrid.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, ids):
    low = list(range(len(fps)))

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= 3:
                low[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(root(i), []).append(ids[i])
    return {ids[i]: min(groups[root(i)]) for i in range(len(fps))}


def flipped(rng, fp, n):
    for b in rng.sample(range(64), n):
        fp ^= 1 << b
    return fp - (1 << 64) if fp >> 63 & 1 and fp >= 0 else fp


def planted(n, seed):
    rng, out = random.Random(seed), []
    for _ in range(n):
        fp = rng.getrandbits(64)
        out += [fp] + [flipped(rng, fp, k) % (1 << 64) for k in (1, 2, 3, 3, 4, 5, 6)]
    return [x - (1 << 64) if x >> 63 else x for x in out]


def test_fingerprint_matches_plain_form():
    for t in [None, "", " \t\n", "One", "one TWO", "a b c", "Straße É é\x0bx\x0cy z", "x " * 70_000 + "end", "a b c a b c a b c"]:
        assert simhash.fingerprint_of(t) & (1 << 64) - 1 == plain_fingerprint(t)


def test_spark_hash_is_the_same(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("a b ç")).alias("h")).first()
    assert row.h & (1 << 64) - 1 == xxhash.xxh64_intdigest("a b ç".encode(), 42)


def test_links_find_all_components(spark):
    fps = planted(60, 3)
    ids = list(range(100, 100 + len(fps)))
    out = simhash.near_duplicates(spark.createDataFrame(list(zip(ids, fps)), "doc_id long, fp long"))
    assert {r.doc_id: r.component_id for r in out.collect()} == plain_components(fps, ids)


def test_dense_buckets_keep_their_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HEAVY", 3)
    monkeypatch.setattr(simhash, "BLOCK", 4)
    rng = random.Random(5)
    fps = list({flipped(rng, 0x1234567890ABCDEF, rng.choice([1, 2, 3, 4])) for _ in range(80)}) + planted(10, 9)
    ids = list(range(len(fps)))
    out = simhash.near_duplicates(spark.createDataFrame(list(zip(ids, fps)), "doc_id long, fp long"))
    assert {r.doc_id: r.component_id for r in out.collect()} == plain_components(fps, ids)


def test_nulls_ties_repeats_and_empty(spark):
    rows = [(3, "a b c d"), (2, "A b c d"), (2, "a b c d"), (None, "a  b c d"), (7, None), (8, ""), (None, "other words here now")]
    out = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r.doc_id, r.component_id) for r in out.collect()), key=str)
    assert got == sorted([(2, 2), (2, 2), (3, 2), (7, 7), (8, 7), (None, 2), (None, None)], key=str)
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_one_keeps_columns_and_one_row_of_each_group(spark):
    rows = [(3, "a b c d", 1, "x"), (2, "A b c d", 2, "y"), (2, "a b c d", 3, "z"), (None, "a  b c d", 4, "w"), (9, "quite another text", 5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int, row_no string")
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 9]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 140)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)}


def test_forest_spans():
    fps = np.array([0, 1, 3, 7, 15, -1], np.int64)
    assert len(simhash.forest(fps, fps, fps)) == 4
