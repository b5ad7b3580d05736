"""Language identification by nearest centroid (operator 8).

Texts become normalised TF-IDF vectors of hashed byte bigrams and trigrams of their letters. Document
frequencies cover every training row. Each language gets several centroids by spherical k-means over a
sample of at most about ``SAMPLE`` distinct texts (the rows with the smallest text hashes; a documented
bound). A text takes the language of the centroid of largest cosine; one further from it than nearly all
of the centroid's own sample is flagged as rejected.

A null text, or one without a letter, is ``und`` with score 0. Null languages aren't learned from; with
nothing learned every text is ``und``. Repeated rows count in frequencies and once in a sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 8192
CENTROIDS = 4
SAMPLE = 1500
ROUNDS = 8
#: Cosine below this quantile of a centroid's own sample is far.
FAR_QUANTILE = 0.002
SHARPNESS = 25.0
_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def letters(text: str) -> bytes:
    """Lower-cased words of letters, a blank around each."""
    words = text.lower().encode("utf-8", "replace").translate(_FOLD).split()
    return b" " + b" ".join(words) + b" " if words else b""


def ngram_counts(text: str) -> np.ndarray:
    b = np.frombuffer(letters(text), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(DIMENSIONS, np.int64)
    two = b[:-1] * np.uint32(0x9E3779B1) ^ b[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) ^ b[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    mixed = [(x ^ x >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> shift for x in (two, three)]
    return np.bincount(mixed[0], minlength=DIMENSIONS) + np.bincount(mixed[1], minlength=DIMENSIONS)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for i, t in enumerate(texts):
        out[i] = ngram_counts(t)
    np.log1p(out, out=out)
    out *= idf
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=out, where=size > 0)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, rows = np.zeros(DIMENSIONS, np.int64), {}
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1)):
            df += ngram_counts(text.as_py()) > 0
            rows[lang.as_py()] = rows.get(lang.as_py(), 0) + 1
    yield pa.RecordBatch.from_pydict({"bin": pa.array([*range(DIMENSIONS), *[-1] * len(rows)], pa.int32()), "lang": pa.array([None] * DIMENSIONS + list(rows), pa.string()), "n": pa.array([*df.tolist(), *rows.values()], pa.int64())})


def spherical_kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centroids of unit length; seeds are the mean's nearest row, then the row furthest from all seeds."""
    k = min(k, len(x))
    seeds = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(seeds) < k:
        seeds.append(int(np.argmin((x @ x[seeds].T).max(axis=1))))
    c = x[seeds].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        for j in range(k):
            if (own == j).any():
                c[j] = x[own == j].mean(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(train: DataFrame, text: str, lang: str) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """(idf, language of each centroid, centroids, far limits). Sizes: languages x CENTROIDS x DIMENSIONS."""
    rows = train.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    counted = rows.mapInArrow(_frequencies, "bin int, lang string, n long").groupBy("bin", "lang").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIMENSIONS)
    for r in counted:
        if r.bin >= 0:
            df[r.bin] = r.n
    sizes = {r.lang: r.n for r in counted if r.bin < 0}
    idf = (np.log((1 + sum(sizes.values())) / (1 + df)) + 1).astype(np.float32)
    if not sizes:
        return idf, [], np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, np.float32)
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, SAMPLE / n)))])
    place = F.shiftrightunsigned(F.xxhash64("text"), 11) / F.lit(float(1 << 53))
    sample = rows.where(place < share[F.col("lang")]).dropDuplicates(["lang", "text"])

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        x = vectors(pdf["text"].tolist(), idf)
        c = spherical_kmeans(x, CENTROIDS, ROUNDS)
        near = x @ c.T
        own = np.argmax(near, axis=1)
        far = [float(np.quantile(near[own == j, j], FAR_QUANTILE)) if (own == j).any() else 1.0 for j in range(len(c))]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": [row.tolist() for row in c], "far": far})

    got = sample.groupBy("lang").applyInPandas(cluster, "lang string, centroid array<float>, far double").orderBy("lang", "far").collect()
    return idf, [r.lang for r in got], np.array([r.centroid for r in got], np.float32), np.array([r.far for r in got], np.float32)


def predict(df: DataFrame, id_cols: list[str], text: Column, model) -> DataFrame:
    """``id_cols`` with lang_pred, score (0 to 1), cosine and rejected."""
    idf, langs, centroids, far = model
    names = sorted(set(langs))
    group = np.array([names.index(x) for x in langs], int)
    schema = T.StructType([*df.select(*id_cols).schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cosine", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    n = len(id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 256):
                batch = whole.slice(start, 256)
                texts = batch.column(n).to_pylist()
                told = np.array([bool(names) and has_letter(t) for t in texts], bool)
                lang, score, cosine, rejected = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
                if told.any():
                    near = vectors([t for t, ok in zip(texts, told) if ok], idf) @ centroids.T
                    by_lang = np.stack([near[:, group == g].max(axis=1) for g in range(len(names))], axis=1)
                    best = by_lang.argmax(axis=1)
                    odds = np.exp(SHARPNESS * (by_lang - by_lang.max(axis=1, keepdims=True)))
                    lang[told] = np.array(names, object)[best]
                    score[told] = 1 / odds.sum(axis=1)
                    cosine[told] = near.max(axis=1)
                    rejected[told] = near.max(axis=1) < far[near.argmax(axis=1)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(lang, pa.string()), pa.array(score), pa.array(cosine), pa.array(rejected)], [*batch.schema.names[:n], "lang_pred", "score", "cosine", "rejected"])

    return df.select(*id_cols, text.alias("_text")).mapInArrow(run, schema)
