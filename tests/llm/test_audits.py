"""Source divergence, licence scans and the prefix trie against plain forms."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hushgrid.llm import divergence, licences, prefix_trie
from hushgrid.llm.common import free_names


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---- source divergence


def plain_audit(rows, least=divergence.LEAST_DOCUMENTS):
    """rows: (lang, source, text)."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = re.findall(divergence.TERM, lowered(text))
        groups.add((lang, source))
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = set()
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        price = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p = price(counts[lang, source])
        pairs = [(-sum(abs(p[t] - o[t]) for t in kept), s.encode(), s) for other, s in groups if other == lang and s != source for o in [price(counts[lang, s])]]
        q = price(sum((counts[g] for g in groups if g[0] == lang), Counter()))
        terms = [(-(p[t] - q[t]), t.encode(), t) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, 50)):
            out |= {(lang, source, part, item, -v, r) for r, (v, _, item) in enumerate(sorted(found)[:most], 1)}
    return out


def audited(spark, rows):
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("term", F.lit(1)).withColumn("LANG_", F.lit(2)).repartition(3)
    got = divergence.audit(df, F.col("lang"), F.col("source"), F.col("text")).collect()
    return got


def divergence_rows(rng):
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in ("x", "yé", "Z")]
    rows = []
    for i in range(700):
        lang = rng.choice(["en", "en", "en", "de", None])
        source = "hot" if rng.random() < 0.4 else rng.choice([None, *[f"s{k}" for k in range(19)]])
        rows.append((lang, source, rng.choice([None, "", " ".join(rng.choices(vocabulary, k=rng.randint(1, 40)))]) if rng.random() < 0.1 else " ".join(rng.choices(vocabulary, weights=range(1, 31), k=rng.randint(1, 40)))))
    rows += [("en", "copies", "ax ax byé")] * 40 + [("xx", "alone", "rare")] + [("yy", s, "few words") for s in "ab"]
    return rows + [("en", "long", "ax " * 50_000 + "cZ")]


@pytest.mark.parametrize("terms,groups", [(512, 8), (4, 3)])
def test_divergence_is_the_plain_difference(spark, monkeypatch, terms, groups):
    rows = divergence_rows(random.Random(5))
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "GROUPS", groups)
    got = audited(spark, rows)
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == plain_audit(rows)


def test_divergence_without_terms_and_without_rows(spark):
    rows = [("a", "x", "one"), ("a", "y", None), (None, None, "")]
    assert {tuple(r) for r in audited(spark, rows)} == {("a", "x", "pair", "y", 0, 1), ("a", "y", "pair", "x", 0, 1)}
    assert audited(spark, []) == []


# ---- licences


def plain_scan(text, templates):
    words = re.findall(licences.WORDS, lowered(text))
    places = []
    for t in templates:
        for start in range(-len(t.words), len(words)):
            ok = all(
                any(words[x : x + len(p)] == p for x in range(max(0, start + at - (licences.SLACK if k else 0)), start + at + (licences.SLACK if k else 0) + 1)) for k, (at, p) in enumerate(t.phrases)
            )
            if ok:
                places.append((t.label, t.base, start, sum(words[start + j] == w for j, w in enumerate(t.words) if 0 <= start + j < len(words)) / len(t.words)))
    return len(words), places


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("Labels", F.lit("mine")).repartition(3)
    return licences.scan(df, ["id", "Labels"], F.col("text"))


def test_licences_as_a_search_without_an_index(spark):
    rng, every = random.Random(3), licences.BASE + licences.NOTICES
    texts = [None, "", "   ", "mit license", "Licensed CC BY-NC 4.0; MIT  license, mit\nLICENSE", "license mit", "gnu general gnu general public license public license", "x" * 100_000, "the software " * 40_000 + "MIT License", *(f"See {t.wording}." for t in every)]
    for _ in range(120):
        t = rng.choice(every)
        words = t.words[rng.choice([0, 0, 0, 1, 2]) :]
        for _ in range(rng.choice([0, 0, 1, 3])):
            at = rng.randrange(len(words) + 1)
            words = words[:at] + rng.choices(["acme", "2020", "license", "software", "é"], k=rng.choice([1, 2, 14])) + words[at:]
        texts.append(rng.choice(["", "Some words. "]) + rng.choice([" ", "\n", ", "]).join(w.upper() if rng.random() < 0.2 else w for w in words) + rng.choice(["", " tail words"]))
    out = scanned(spark, texts)
    assert out.columns == ["id", "Labels_", "n_words", "places", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = {r.id: r for r in out.collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        n, places = plain_scan(text, every)
        base = [p[2] for p in places if p[1]]
        r = got[i]
        assert (r.n_words, sorted(map(tuple, r.places))) == (n, sorted(places)), text
        assert (r.n_base, r.first_word, r.last_word) == (len(base), min(base, default=None), max(base, default=None))
        assert r.labels == ",".join(sorted({p[0] for p in places})) and r.base_labels == ",".join(sorted({p[0] for p in places if p[1]}))
        assert r.score == max((p[3] for p in places), default=0.0)
    assert {x for r in got.values() for x in r.labels.split(",")} > {"mit", "gpl-3.0", "apache-2.0", "bsd-3-clause", "zlib"}


def test_licences_of_no_rows_and_without_matches(spark):
    assert scanned(spark, []).count() == 0
    assert [(r.n_words, r.labels, r.score) for r in scanned(spark, ["nothing of the kind"]).collect()] == [(4, "", 0.0)]


def test_names_differ_whatever_their_case():
    assert free_names(["Shard", "shard_", "x"], ["shard"]) == ["Shard__", "shard_", "x"]


# ---- prefix trie


def plain_trie(rows):
    """rows: (conv_id, turn, role, text) without ties of turns."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h, source = zlib.crc32(str(c).encode()) % 4, own.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])
        whole[c] = source[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    saved = {p: (len(m) - 1) * words(p[-1][1]) if p else 0 for p, m in nodes.items()}
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, tokens = Counter(), Counter()
    for p in nodes:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            tokens[p[:d]] += saved[p]
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in nodes[p] if len(whole[c]) == len(p)))).encode()).hexdigest()
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], tokens[p], ends(p)) for p, m in nodes.items())


def grown(spark, rows, block):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rank", F.lit(1)).repartition(3)
    out = prefix_trie.trie(prefix_trie.share_openings(prefix_trie.sequences(df)), block).collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out)


def conversations(rng):
    rows = []
    for c in [*range(-3, 90), *range(200, 230)]:
        if c % 7 == 3:
            turns = [("user", "the same opening words"), ("assistant", "one answer"), ("user", "the end")]  # a large group of copies
        else:
            turns = [(rng.choice(["user", None, "assistant"]), rng.choice([None, "", "a", "b c", "d\te f"])) for _ in range(rng.randint(1, 6))]
        rows += [(c, None if k == 0 and c % 5 == 0 else k, *t) for k, t in enumerate(turns)]
    rows += [(300, k, "user", f"turn {k % 3}") for k in range(120)] + [(301, k, "user", f"turn {k % 3}") for k in range(119)]
    return [*rows, (None, 1, "user", "lost"), (400, 0, "user", "word " * 60_000), (401, 0, None, None)]


@pytest.mark.parametrize("block", [4096, 16, 3])
def test_trie_is_the_plain_one(spark, block):
    rows = conversations(random.Random(9))
    assert grown(spark, rows, block) == plain_trie(rows)


def test_trie_of_turnless_and_of_no_conversations(spark):
    rows = [(c, 0, "u", "x") for c in (21, 22, 23, 24, 25)]  # some have no turns left
    assert grown(spark, rows, 2) == plain_trie(rows)
    assert grown(spark, [], 4) == []


def test_repeated_turns_count_as_turns(spark):
    rows = [(1, 1, "u", "a")] * 2 + [(2, 1, "u", "a")]
    seqs = prefix_trie.sequences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted((r.depth, r.n_convs) for r in prefix_trie.trie(seqs).collect()) == [(0, 2), (1, 2), (2, 1)]
