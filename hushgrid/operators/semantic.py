"""The statistical hint model: naive Bayes over character features, windows, hint unions and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ngrams

WINDOW, OVERLAP, CLAMP = 120_000, 160, 12.0


def train(samples: DataFrame) -> DataFrame:
    """(kind, feature, pos, neg, pos_total, neg_total, vocabulary) from samples (kind, positive, context)."""
    feats = samples.select("kind", "positive", F.explode(ngrams(F.col("context"))).alias("feature"))
    n = feats.groupBy("kind", "feature").agg(F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg"))
    total = n.groupBy("kind").agg(F.sum("pos").alias("pos_total"), F.sum("neg").alias("neg_total"), F.count("*").alias("vocabulary"))
    return n.join(total, "kind")


def score(contexts: DataFrame, model: DataFrame) -> DataFrame:
    """(id, kind, score) of contexts (id, kind, context): add-one odds of the known features, clamped, as a
    probability; 0 where no feature has positive evidence."""
    feats = contexts.select("id", "kind", F.posexplode_outer(ngrams(F.col("context"))).alias("at", "feature"))
    hit = feats.join(model, ["kind", "feature"], "left")  # contexts without a known feature stay, so nothing is joined back
    odds = F.log((F.col("pos") + 1) / (F.col("pos_total") + F.col("vocabulary"))) - F.log((F.col("neg") + 1) / (F.col("neg_total") + F.col("vocabulary")))
    per = hit.groupBy("id", "kind").agg(F.sum(odds).alias("z"), F.sum("pos").alias("evidence"), F.count_if(F.coalesce("at", F.lit(0)) == 0).cast("int").alias("rows"))
    z = F.least(F.greatest(F.col("z"), F.lit(-CLAMP)), F.lit(CLAMP))
    each = per.withColumn("_row", F.explode(F.sequence(F.lit(1), "rows")))  # one for each context of that id and kind
    return each.select("id", "kind", F.when(F.coalesce("evidence", F.lit(0)) > 0, 1 / (1 + F.exp(-z))).otherwise(0.0).alias("score"))


def windows(df: DataFrame, keys: list[str], text: str, core: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(keys, lo, hi, piece): cores of ``core`` characters with ``overlap`` more on both sides; short texts are one."""
    n = F.length(text)
    each = df.select(*keys, F.col(text).alias("_t"), F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(core))).alias("lo"))
    lo = F.greatest(F.col("lo") - overlap, F.lit(0))
    return each.select(*keys, "lo", F.least(F.col("lo") + core, F.length("_t")).alias("hi"), F.substring("_t", lo + 1, F.least(F.col("lo") + core + overlap, F.length("_t")) - lo).alias("piece"))


def union_hints(providers: list[DataFrame], keys: list[str]) -> DataFrame:
    """Hints of several providers; of equal spans the first provider's best score stays."""
    ranked = [p.withColumn("provider", F.lit(i)) for i, p in enumerate(providers)]
    all_ = ranked[0]
    for r in ranked[1:]:
        all_ = all_.unionByName(r)
    w = Window.partitionBy(*keys, "kind", "start", "end").orderBy("provider", F.col("score").desc())
    return all_.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def cached_review(texts: DataFrame, text: str, review) -> DataFrame:
    """Review each distinct text once and join the results back by a digest of 256 bits."""
    keyed = texts.withColumn("_h", F.sha2(F.coalesce(text, F.lit("")), 256))
    once = review(keyed.groupBy("_h").agg(F.first(text).alias(text)))
    return keyed.join(once.drop(text), "_h").drop("_h")


def hint_score(evidence: Column, learned: Column) -> Column:
    """The better of both; a hint is never rejected by it."""
    return F.greatest(F.coalesce(evidence, F.lit(0.0)), F.coalesce(learned, F.lit(0.0)))


def distinct_hints(hints: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, start, end, score): one hint for each span and kind, with its best score."""
    return hints.groupBy(*keys, "kind", "start", "end").agg(F.max("score").alias("score"))


def accepted_reviews(requests: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Results that answer a request as it is now: same id, same text. Results of other or older texts go."""
    asked = requests.select(key, F.sha2("text", 256).alias("digest"))
    return results.join(asked, [key, "digest"], "left_semi")


def valid_hint(kinds_known: tuple[str, ...], length: Column) -> Column:
    """A hint with a known kind, an integer span in bounds, a finite score and the confirmation flag."""
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    return F.col("kind").isin(*kinds_known) & (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= length) & finite & F.col("requires_confirmation")
