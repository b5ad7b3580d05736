"""Registered queries of the operators and their SQL, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, divergence, langid, licences, linededup, mixing, ngram_lm, prefix_trie, quality, sharding, toxicity
from .common import fold_of, scratch, table
from .simhash import simhash_components


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select_mix(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "lines_before", "lines_removed", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("after_md5"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


def op6_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold_of(F.col("doc_id"), 7) == 2)
    model = ngram_lm.fit(docs.where(~F.col("held_out")), F.col("text"), least=1)
    return model.score(docs, ["doc_id", "held_out"], F.col("text")).withColumn("train_tokens", F.lit(model.sums["tokens"]).cast("long"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold_of(F.col("doc_id"), 5) == 0)
    model = langid.fit(docs.where(~F.col("held_out")), "text", "lang")
    return langid.predict(docs, ["doc_id", "held_out"], F.col("text"), model)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stored = sharding.shard_table(docs, scratch(spark, "shards"))
    return stored.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), "shard", "level", "version")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold_of(F.col("doc_id"), 4) == 2)
    labels = table(spark, sf_dir, "labels").where(fold_of(F.col("doc_id"), 4) != 2)
    model = toxicity.fit(docs, labels, "doc_id", "text", "toxic")
    return toxicity.score(docs, ["doc_id", "held_out"], F.col("text"), model).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), F.col("lang"), F.col("source"), F.col("text"))


def op12_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"), ["doc_id"], F.col("text")).drop("places")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.share_openings(prefix_trie.sequences(table(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_ann, op2_mixing, op3_quality, op4_linededup, op5_decontaminate, op6_ngram_lm, op7_simhash, op8_langid, op9_sharding, op10_toxicity, op11_divergence, op12_licences, op13_prefix_trie)
    return {q.__name__: q for q in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.oracle_sql(), "op4_linededup": linededup.oracle_sql(), "op5_decontaminate": decontaminate.oracle_sql(), "op11_divergence": divergence.oracle_sql(), "op12_licences": licences.oracle_sql(), "op13_prefix_trie": prefix_trie.oracle_sql()}
