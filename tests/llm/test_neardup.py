"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import random

import numpy as np
import pytest

import corpus_pipeline
from hushgrid.llm import neardup
from hushgrid.llm.common import table

SMALL = "/root/testdata/sf0.001"


def plain_sets(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_keep(rows):
    """Ids that stay; rows: (id, text), ids distinct."""
    sets, low = [plain_sets(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * len(sets[i] | sets[j]):
                low[max(root(i), root(j))] = min(root(i), root(j))
    first = {}
    for i, (k, _) in enumerate(rows):
        first[root(i)] = min(k, first.get(root(i), k))
    return sorted(first.values())


def planted(rng):
    words = [f"w{k}" for k in range(3000)]
    common = " ".join(rng.choice(words) for _ in range(60))
    texts = [None, "", " \n", "one two", "One two", "one two three"]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(20, 150))]
        texts.append(" ".join(base))
        for edits in (1, 1, 2, 3, 5):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy) + rng.choice(["", " tail", " " + common]))
    group = [rng.choice(words) for _ in range(200)]
    for _ in range(50):
        copy = list(group)
        for _ in range(rng.randrange(7)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    return list(enumerate(texts))


@pytest.mark.parametrize("common", [64, 3])
def test_all_similar_texts_are_linked_and_no_others(spark, monkeypatch, common):
    monkeypatch.setattr(neardup, "COMMON", common)
    rows = planted(random.Random(4))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in neardup.keep_one(df).collect()) == plain_keep(rows)


def test_common_shingles_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HEAVY", 3)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rows = planted(random.Random(8))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in neardup.keep_one(df).collect()) == plain_keep(rows)


def test_bridges_join_what_similar_pairs_join():
    rng = random.Random(2)
    base = [rng.sample(range(10_000), 60) for _ in range(6)]
    sets = [np.unique(np.array([x if rng.random() > 0.07 else rng.randrange(10_000) for x in rng.choice(base)], np.uint64)) for _ in range(150)]
    found = neardup.bridges(np.arange(150), np.arange(150), sets)
    low = list(range(150))

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in found:
        assert len(np.intersect1d(sets[a], sets[b])) * 5 >= 4 * len(np.union1d(sets[a], sets[b])) and root(a) != root(b)
        low[max(root(a), root(b))] = min(root(a), root(b))
    assert all(root(i) == root(j) for i in range(150) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) * 5 >= 4 * len(np.union1d(sets[i], sets[j])))


def test_whole_sets_of_a_common_shingle_are_read_where_a_similar_text_is_possible(spark, monkeypatch):
    """A passage that many unlike texts share doesn't make all of them be compared as whole sets."""
    monkeypatch.setattr(neardup, "COMMON", 1000)
    monkeypatch.setattr(neardup, "HEAVY", 3)
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(12))
    rows = [(i, f"{passage} " + " ".join(f"w{rng.randrange(100_000)}" for _ in range(60))) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " end") for i in range(3)]
    read, real = [], neardup._sets
    monkeypatch.setattr(neardup, "_sets", lambda ids, *a: read.append(ids.count()) or real(ids, *a))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in neardup.keep_one(df).collect()) == plain_keep(rows) == list(range(120))
    assert len(read) == 3 and read[-1] < 12  # stars, pairs of rare shingles, squares


def test_hopeful_keeps_every_node_that_has_a_similar_one():
    rng = random.Random(3)
    base = [rng.sample(range(10_000), 60) for _ in range(6)]
    sets = [np.unique(np.array([x if rng.random() > 0.05 else rng.randrange(10_000) for x in rng.choice(base)], np.uint64)) for _ in range(150)]
    prefixes = [neardup.prefix_of(h, np.zeros(0, np.uint64), np.zeros(0, np.int32))[0].view(np.int64) for h in sets]
    g = np.array([i % 40 for i in range(150)])
    found = neardup.hopeful(g, np.array([len(s) for s in sets]), prefixes)
    similar = [any(g[i] != g[j] and len(np.intersect1d(sets[i], sets[j])) * 5 >= 4 * len(np.union1d(sets[i], sets[j])) for j in range(150)) for i in range(150)]
    largest = np.bincount(g).argmax()
    assert any(similar) and all(found[i] for i in range(150) if similar[i] and g[i] != largest)
    assert not neardup.hopeful(np.arange(150), np.array([len(s) for s in sets]), [np.array([1])] * 150).any()


def test_sketches_lose_no_similar_pair_and_spare_most_others():
    """Sets of many sizes; folded sketches bound what two sets have apart from below."""
    rng = np.random.default_rng(6)
    similar = unlike = kept = 0
    for size in (0, 1, 2, 5, 63, 64, 65, 300, 1100, 5000):
        base = rng.integers(0, 1 << 63, size, np.uint64)
        for share in np.linspace(0.5, 1, 40):
            other = np.unique(np.concatenate([base[: int(size * share)], rng.integers(0, 1 << 63, int(size * (1 - share) * rng.random()), np.uint64)]))
            x = np.unique(base)
            both, either = len(np.intersect1d(x, other)), len(np.union1d(x, other))
            may = neardup.may_be_similar(neardup.sketch_of(x), neardup.sketch_of(other), len(x) + len(other))
            assert may == neardup.may_be_similar(neardup.sketch_of(other), neardup.sketch_of(x), len(x) + len(other))
            if 5 * both >= 4 * either:
                similar += 1
                assert may
            elif 2 * len(other) > size and 10 * both < 7 * either:
                unlike += 1
                kept += may
    assert similar > 100 and unlike > 50 and kept * 5 < unlike


def test_whole_sets_are_read_only_where_sketches_leave_a_pair_possible(spark, monkeypatch):
    """Texts that share over half of their shingles, rare ones, are candidates; they are no more shipped as whole sets."""
    rng = random.Random(9)
    rows = []
    for k in range(30):
        half = [f"h{rng.randrange(100_000)}" for _ in range(130)]
        rows += [(2 * k + i, " ".join(half + [f"w{rng.randrange(100_000)}" for _ in range(60)])) for i in range(2)]
    rows.append((100, rows[0][1] + " end"))
    read, real = [], neardup._sets
    monkeypatch.setattr(neardup, "_sets", lambda ids, *a: read.append(ids.count()) or real(ids, *a))
    monkeypatch.setattr(neardup, "BUDGET", 64)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in neardup.keep_one(df).collect()) == plain_keep(rows) == list(range(60))
    assert max(read) < 8


def test_stage_leaves_no_similar_pair(spark):
    docs = table(spark, SMALL, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, SMALL).collect()) == plain_keep(rows)


def test_nulls_repeats_and_columns(spark):
    rows = [(3, "a b c d", 1, "x"), (2, "A b c d", 2, "y"), (2, "a b c d", 3, "z"), (None, "a  b c d", 4, "w"), (9, "quite another text", 5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int, row_no string")
    out = neardup.keep_one(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [2, 9]
    assert neardup.keep_one(df.limit(0)).count() == 0
