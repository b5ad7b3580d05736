"""Quality classifier with hierarchical empirical Bayes (operator 3).

Evidence of a document: binned measures of its whole text, each bin's log likelihood ratio learned from
all labelled rows by grouped counts. Sites: the mean probability of a host is shrunk toward the global
one, that of a path toward its host's, both by strengths from an analysis of variance: the variance within
groups over that between them, from which the share that sampling alone makes is taken off. A document's log odds are its evidence plus those of its path, its own share left
out. Both aggregations combine before the shuffle, so a hot host is a few partial sums.

Null or empty texts have the bins of no words; very long ones are measured whole. A null host or path is a group of its own. Null labels
are left out; of several labels of one id the smaller counts. Without labels of both kinds the evidence
is 0 and every row is kept. Repeated rows are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_path, materialize, small_batches, written

#: Share of the naive sum of log ratios that counts, as measures of one text depend on each other.
TEMPER = 0.7
SMOOTH = 0.5
KEEP_AT = 0.5
#: Bounds of the strengths.
LEAST, MOST = 1.0, 1e4
MEASURES = ("repeats", "variety", "symbols", "capitals", "digits", "word_length", "ends")
#: More than any bin's number.
_BINS = 100_000
_SYMBOLS = b"|#$%&*@^~<>{}[]_=+\\/"


def bins_of(text: str | None) -> list[int]:
    """One bin for each of MEASURES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    if not n:
        return [-1] * len(MEASURES)
    of = lambda part, whole, steps: min(steps, int(steps * part / max(1, whole)))
    scale = min(12, n.bit_length())
    return [
        of(sum(map(eq, words, words[1:])), n, 20),
        scale * 100 + of(len(set(words)), n, 20),
        of(size - len(raw.translate(None, _SYMBOLS)), size, 50),
        of(size - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")), size, 25),
        of(size - len(raw.translate(None, b"0123456789")), size, 25),
        min(40, 2 * len(raw) // n),
        of(raw.count(b".") + raw.count(b"!") + raw.count(b"?"), n, 25),
    ]


def bins(text: Column) -> Column:
    @F.pandas_udf("array<int>")
    def binned(texts: pd.Series) -> pd.Series:
        return pd.Series([bins_of(t) for t in texts], dtype=object)

    return binned(text)


@dataclass
class QualityModel:
    evidence: dict[tuple[int, int], float]
    prior: float
    sites: DataFrame  # host, path, n, total, parent, strength

    def log_ratio(self, binned: Column) -> Column:
        if not self.evidence:
            return F.lit(0.0)
        known = F.create_map(*[F.lit(x) for (m, b), w in self.evidence.items() for x in (m * _BINS + b, TEMPER * w)])
        terms = F.transform(binned, lambda b, m: F.coalesce(F.try_element_at(known, m * _BINS + b), F.lit(0.0)))
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def _logit(p: Column) -> Column:
    safe = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(safe / (1 - safe))


def _strength(groups: DataFrame) -> float:
    """Prior rows that a parent's mean is worth. groups: n, total and squares (sums of p and p^2), up_n and up_total of the parent.

    Without a group of two rows, or where sampling alone explains the spread, sites tell nothing: the most.
    """
    rate, parent = F.col("total") / F.col("n"), F.col("up_total") / F.col("up_n")
    r = groups.agg(
        F.sum("n").alias("n"), F.count("*").alias("groups"), F.sum(F.col("n") / F.col("up_n")).alias("parents"), F.sum(F.col("n") * F.col("n") / F.col("up_n")).alias("own"),
        F.sum(F.greatest(F.col("squares") - F.col("total") * rate, F.lit(0.0))).alias("within"), F.sum(F.col("n") * (rate - parent) ** 2).alias("between"),
    ).first()
    if not r.n or r.n <= r.groups or r.n - r.own < 1e-9:
        return MOST
    within = r.within / (r.n - r.groups)
    between = (r.between - (r.groups - r.parents) * within) / (r.n - r.own)
    return MOST if between <= within / MOST else max(LEAST, within / between)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, host: str, path: str, label: str) -> tuple[QualityModel, DataFrame]:
    """The model, and the judged rows of ``docs`` without their texts: id, host, path, ratio."""
    return fit_measured(materialize(docs.select(*_sites(id_col, host, path), bins(F.col(text_col)).alias("bins")), "measures"), labels, id_col, label)


def _sites(id_col: str, host: str, path: str) -> list[Column]:
    return [F.col(f"`{id_col}`").alias("id"), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((host, "host"), (path, "path"))]]


def fit_measured(slim: DataFrame, labels: DataFrame, id_col: str, label: str) -> tuple[QualityModel, DataFrame]:
    """``fit`` over a written table of id, host, path and bins."""
    told = labels.where(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label).cast("int").alias("good"))
    # bounded: measures times bins
    counted = slim.join(told, "id").select("good", F.posexplode("bins").alias("m", "b")).groupBy("m", "b").agg(F.sum("good").alias("good"), F.count("*").alias("n")).collect()
    good = sum(r.good for r in counted if r.m == 0)
    bad = sum(r.n for r in counted if r.m == 0) - good
    evidence = {}
    if good and bad:
        kinds = [sum(r.m == m for r in counted) for m in range(len(MEASURES))]
        for r in counted:
            k = SMOOTH * kinds[r.m]
            evidence[r.m, r.b] = float(np.log((r.good + SMOOTH) / (good + k)) - np.log((r.n - r.good + SMOOTH) / (bad + k)))
    prior = (good + 1) / (good + bad + 2) if good and bad else 0.5
    model = QualityModel(evidence, prior, slim)
    judged = slim.select("id", "host", "path", model.log_ratio(F.col("bins")).alias("ratio"))
    p = 1 / (1 + F.exp(-(F.col("ratio") + float(np.log(prior / (1 - prior))))))
    paths = materialize(judged.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("total"), F.sum(p * p).alias("squares")), "paths")
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])
    every = hosts.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    mean = every.total / every.n if every.n else prior
    k_host = _strength(hosts.withColumns({"up_n": F.lit(every.n or 1), "up_total": F.lit(every.total or 0.0)}))
    up = hosts.select("host", F.col("n").alias("up_n"), F.col("total").alias("up_total"), ((F.col("total") + k_host * mean) / (F.col("n") + k_host)).alias("parent"))
    under = paths.join(up, "host")
    k_path = _strength(under)
    model.sites = materialize(under.select("host", "path", "n", "total", "parent", F.lit(k_path).alias("strength")), "sites")
    return model, judged


def with_posterior(judged: DataFrame, model: QualityModel) -> DataFrame:
    """``judged`` (host, path, ratio and more) with site_mean, p_good and keep."""
    own = 1 / (1 + F.exp(-(F.col("ratio") + float(np.log(model.prior / (1 - model.prior))))))
    site = (F.col("total") - own + F.col("strength") * F.col("parent")) / (F.col("n") - 1 + F.col("strength"))
    return (
        judged.join(model.sites, ["host", "path"]).withColumn("site_mean", site)
        .withColumn("p_good", 1 / (1 + F.exp(-(F.col("ratio") + _logit(F.col("site_mean"))))))
        .withColumn("keep", F.col("p_good") >= KEEP_AT).drop("n", "total", "parent", "strength")
    )


def judge(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", host="source", path="lang", label="quality") -> DataFrame:
    """(id, host, path, ratio, site_mean, p_good, keep) for every row of ``docs``."""
    model, judged = fit(docs, labels, id_col, text_col, host, path, label)
    return with_posterior(judged, model).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", host="source", path="lang", label="quality") -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``. Texts are measured once, in small Arrow batches."""
    spark = docs.sparkSession
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], *_sites(id_col, host, path))
    copied = written(rows, "copied")
    measured = small_batches(spark).read.schema(rows.schema).parquet(copied).select("*", bins(F.col(own[text_col])).alias("bins"))
    whole = spark.read.schema(measured.schema).parquet(written(measured, "measured"))
    drop_path(spark, copied)
    model, _ = fit_measured(whole.select("id", "host", "path", "bins"), labels, id_col, label)
    judged = whole.select(*own.values(), "host", "path", model.log_ratio(F.col("bins")).alias("ratio"))
    return with_posterior(judged, model).where("keep").select(*[F.col(n).alias(c) for c, n in own.items()])
