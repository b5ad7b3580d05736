"""The pipeline against plain forms of its stages on a small table."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hushgrid.llm import decontaminate, mixing, quality
from hushgrid.llm.common import table

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = table(spark, SMALL, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stage_columns(spark, stages):
    columns = table(spark, SMALL, "documents").columns
    assert len(stages) == 5 and all(s.columns == columns for s in stages[:-1])


def test_quality_stage_keeps_what_the_judge_keeps(spark, stages):
    judged = quality.judge(table(spark, SMALL, "documents"), table(spark, SMALL, "labels"))
    assert sorted(r.doc_id for r in judged.where("keep").collect()) == sorted(r.doc_id for r in stages[0].collect())
    labels = {r.doc_id: r.quality for r in table(spark, SMALL, "labels").collect()}
    kept = {r.doc_id for r in stages[0].collect()}
    right = [(i in kept) == (q == 1) for i, q in labels.items()]
    assert sum(right) / len(right) > 0.95


def test_one_of_each_group_stays(stages):
    """Five-word shingles and similarity of 0.8, as the stage links."""
    from test_neardup import plain_keep

    rows = [(r.doc_id, r.text) for r in stages[0].collect()]
    assert sorted(r.doc_id for r in stages[1].collect()) == plain_keep(rows)


def test_benchmark_texts_are_gone(spark, stages):
    flat = lambda t: " ".join((t or "").split())
    items = [flat(r.text) for r in table(spark, SMALL, "benchmark").collect() if len(r.text.split()) >= decontaminate.WINDOW]
    holds = lambda r: any(i in flat(r.text) for i in items)
    before, after = stages[1].collect(), stages[2].collect()
    assert not any(map(holds, after))
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {r.doc_id for r in before if holds(r)}


def test_mix_and_shards_keep_rows(stages):
    copies = {r.doc_id: r.copies for r in mixing.select_mix(stages[2]).collect()}
    mixed = [r.doc_id for r in stages[3].collect()]
    assert sorted(mixed) == sorted(i for i, n in copies.items() for _ in range(n))
    stored = stages[4].collect()
    digest = {r.doc_id: hashlib.md5(r.text.encode()).hexdigest() for r in stages[3].collect()}
    assert sorted(r.doc_id for r in stored) == sorted(mixed) and all(r.text_md5 == digest[r.doc_id] for r in stored)


def test_run_on_nulls_and_empty_tables(spark, tmp_path):
    docs = table(spark, SMALL, "documents").limit(20)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, "src1", 0), (1, "", None, "src1", 0)], docs.schema)
    for name, frame in (("odd", docs.unionByName(odd)), ("empty", docs.limit(0))):
        at = tmp_path / name
        frame.write.parquet(str(at / "documents.parquet"))
        for t in ("labels", "benchmark"):
            small = table(spark, SMALL, t)
            (small if name == "odd" else small.limit(0)).write.parquet(str(at / f"{t}.parquet"))
        n = corpus_pipeline.run(spark, str(at)).agg(F.count("*")).first()[0]
        assert n > 0 if name == "odd" else n == 0
