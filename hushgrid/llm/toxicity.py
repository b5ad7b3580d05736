"""Counterfactually regularised toxicity classifier (operator 10).

A logistic model over the words of a text and their prefixes. It is fitted on a bounded sample of
labelled rows (``SAMPLE`` of each label; a documented bound), with every feature of it that is in ``LEAST_ROWS`` rows
and whose rates in the two labels differ by ``TELLING`` standard errors or so. For every sampled text that names an
identity group, copies with the term swapped for others are made, and the squared change of the score
is added to the loss, so that a group's name alone moves no score. Few texts name one, so of every
``INSERT_EVERY`` of the others of either label one is also learned from with a term put in, and swapped in turn.
Scoring covers whole texts.

The sample has up to as many rows of either label, so the score leans to recall where label 1 is rare.

A null text is scored as an empty one. Rows without a label aren't learned from; of several labels of
one id the larger counts, of several texts the smallest. With one label only, the model predicts that label's
rate. Repeated rows are scored alike, an empty table gives no rows, other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: Words for groups of people, swapped against each other.
IDENTITY_TERMS = (
    "women", "men", "muslims", "christians", "jews", "hindus", "immigrants", "refugees", "gay", "lesbian",
    "transgender", "black", "white", "asian", "disabled", "elderly", "frauen", "männer", "muslime", "christen",
    "juden", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "mujeres", "hombres", "musulmanes", "cristianos",
)
SAMPLE = 4000
LEAST_ROWS, TELLING = 3, 2.5
INSERT_EVERY = 2
SWAPS = 3
PREFIX = 5
STEPS, RATE, RIDGE, FAIR = 200, 1.0, 2e-5, 1.0
_BLANKS = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | None) -> set[bytes]:
    return set((text or "").lower().encode("utf-8", "replace").translate(_BLANKS).split())


def _hash(kind: bytes, word: bytes) -> int:
    return xxhash.xxh64_intdigest(kind + word, 1) >> 1


def features_of(words: set[bytes]) -> set[int]:
    return {_hash(b"w", w) for w in words} | {_hash(b"p", p) for p in {w[:PREFIX] for w in words if len(w) > PREFIX}}


def _pair(term: bytes) -> tuple[int, int]:
    """The features of a term: its word, and its prefix or 0."""
    return _hash(b"w", term), _hash(b"p", term[:PREFIX]) if len(term) > PREFIX else 0


def _swaps(found: list[bytes], terms: list[bytes]) -> tuple[list[int], list[int]]:
    """Two features of each term taken out, and of the term put in its place."""
    swaps = [(t, terms[(terms.index(t) + 1 + 7 * k) % len(terms)]) for t in found for k in range(SWAPS)]
    return [h for a, _ in swaps for h in _pair(a)], [h for _, b in swaps for h in _pair(b)]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of each text and what swaps of its group terms take out and put in; ``own`` is false for copies with a term put in."""
    terms = sorted({t.encode() for t in IDENTITY_TERMS})
    kind = pa.list_(pa.int64())
    for batch in batches:
        rows = []
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = words_of(text.as_py())
            found = [t for t in terms if t in words]
            rows.append((label, True, sorted(features_of(words)), *_swaps(found, terms)))
            drawn = xxhash.xxh64_intdigest((text.as_py() or "").encode("utf-8", "replace"), 2)
            if not found and drawn % INSERT_EVERY == 0:
                term = terms[drawn // INSERT_EVERY % len(terms)]
                rows.append((label, False, sorted(features_of(words | {term})), *_swaps([term], terms)))
        cols = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.bool_()), *(pa.array(c, kind) for c in cols[2:])], ["label", "own", "features", "takes", "puts"])


def telling(examples: DataFrame, positive: int, total: int) -> np.ndarray:
    """Features that tell the labels apart, and those of the identity terms; sorted."""
    counts = examples.where("own").select("label", F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"), F.sum("label").alias("pos")).where(F.col("n") >= LEAST_ROWS)
    rate = lambda k, of: F.log((k + 1) / F.lit(of + 2))
    told = F.abs(rate(F.col("pos"), positive) - rate(F.col("n") - F.col("pos"), total - positive)) * F.sqrt("n")
    found = [r.feature for r in counts.where(told >= TELLING).select("feature").collect()]  # bounded as the sample is
    return np.unique(np.array(found + [h for t in IDENTITY_TERMS for h in _pair(t.encode()) if h], np.int64))


def train(labels: np.ndarray, features: list[np.ndarray], takes: np.ndarray, puts: np.ndarray, ids: np.ndarray, fair: float = FAIR) -> tuple[np.ndarray, float]:
    """(weights of ``ids``, bias): logistic loss with ridge and the counterfactual penalty, by Adam.

    takes, puts: two features of each swapped term, one swap after another.
    """
    y = labels.astype(float)
    rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    bias = float(np.log(rate / (1 - rate)))
    if not len(y) or y.min() == y.max():
        return np.zeros(len(ids)), bias
    known = lambda h: np.where(np.isin(h, ids), np.searchsorted(ids, h), -1) if len(h) and len(ids) else np.full(len(h), -1)
    rows, cols = np.repeat(np.arange(len(y)), [len(f) for f in features]), known(np.concatenate(features))
    rows, cols = rows[cols >= 0], cols[cols >= 0]
    a, b = known(takes).reshape(-1, 2), known(puts).reshape(-1, 2)
    w, m, v = np.zeros(len(ids)), np.zeros(len(ids) + 1), np.zeros(len(ids) + 1)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(rows, weights=w[cols], minlength=len(y))
        err = 1 / (1 + np.exp(-z)) - y
        grad = np.bincount(cols, weights=err[rows], minlength=len(w)) / len(y) + RIDGE * w
        if len(a) and fair:
            change = np.where(a >= 0, w[a], 0).sum(axis=1) - np.where(b >= 0, w[b], 0).sum(axis=1)
            pull = np.repeat(2 * fair * change[:, None] / len(a), 2, axis=1)
            np.add.at(grad, a[a >= 0], pull[a >= 0])
            np.subtract.at(grad, b[b >= 0], pull[b >= 0])
        g = np.append(grad, err.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * m / (np.sqrt(v) + 1e-6) * (1 - step / (STEPS + 1))
        w -= 0.2 * move[:-1]
        bias -= 0.2 * move[-1]
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fair: float = FAIR) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature hashes, weights, bias). ``labels``: id and label (1: toxic). Ids are chosen by hash, at most SAMPLE of
    each label, and sent to the documents; one task learns from the telling features of these rows alone."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    chosen = [known.where(F.col("label") == k).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE) for k in (0, 1)]
    picked = chosen[0].unionByName(chosen[1])
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text")).join(F.broadcast(picked), id_col).groupBy(id_col, "label").agg(F.min("_text").alias("_text")).select("label", "_text")
    examples = materialize(rows.mapInArrow(_examples, "label int, own boolean, features array<long>, takes array<long>, puts array<long>"), "examples")
    total = examples.where("own").agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("pos")).first()
    ids = telling(examples, total.pos, total.n)

    @F.pandas_udf("array<long>")
    def kept(rows: pd.Series) -> pd.Series:
        return pd.Series([(x := np.asarray(f, np.int64))[np.isin(x, ids)] for f in rows], dtype=object)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        flat = lambda c: np.concatenate([np.asarray(x, np.int64) for x in pdf[c]]) if len(pdf) else np.zeros(0, np.int64)
        w, bias = train(pdf["label"].to_numpy(), [np.asarray(x, np.int64) for x in pdf["features"]], flat("takes"), flat("puts"), ids, fair)
        return pd.DataFrame({"feature": [*ids.tolist(), -1], "weight": [*w.tolist(), bias]})

    got = examples.select("label", kept("features").alias("features"), "takes", "puts", F.lit(0).alias("one")).groupBy("one").applyInPandas(learn, "feature long, weight double").collect()
    weights = {r.feature: r.weight for r in got}
    bias = weights.pop(-1, 0.0)
    return ids, np.array([weights.get(i, 0.0) for i in ids.tolist()]), bias


def swap_change(model, terms=IDENTITY_TERMS) -> float:
    """Mean absolute change of the log odds when one identity term takes the place of another."""
    weights = dict(zip(model[0].tolist(), model[1].tolist()))
    moved = [sum(weights.get(h, 0.0) for h in _pair(t.encode())) for t in sorted(set(terms))]
    return float(np.mean([abs(a - b) for i, a in enumerate(moved) for b in moved[:i]]))


def score(df: DataFrame, id_cols: list[str], text: Column, model) -> DataFrame:
    """``id_cols`` with score, the model's probability of label 1."""
    ids, w, bias = model
    n = len(id_cols)
    schema = T.StructType([*df.select(*id_cols).schema, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cache = dict(zip(ids.tolist(), w.tolist())), ({}, {})

        def weight(kind: int, x: bytes) -> float:
            memo = cache[kind]
            if (got := memo.get(x)) is None:
                if len(memo) >= 300_000:
                    memo.clear()
                got = memo[x] = known.get(_hash(b"wp"[kind : kind + 1], x), 0.0)
            return got

        for batch in batches:
            out = np.empty(len(batch))
            for i, text in enumerate(batch.column(n)):
                words = words_of(text.as_py())
                prefixes = {x[:PREFIX] for x in words if len(x) > PREFIX}
                z = bias + sum([weight(0, x) for x in words]) + sum([weight(1, x) for x in prefixes])
                out[i] = 1 / (1 + np.exp(-min(max(z, -500.0), 500.0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out)], [*batch.schema.names[:n], "score"])

    return df.select(*id_cols, text.alias("_text")).mapInArrow(run, schema)
