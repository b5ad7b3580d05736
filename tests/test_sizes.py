"""What one task gets stays the same however large the tables are."""

import re
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from hushgrid.llm.common import small_batches
from hushgrid.operators import neural, resolve
from hushgrid.plans import catalog, model, synthetic


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["highlight_segments", "ocr_rectangles", "leak_rates", "send_action"])
def test_parts_of_candidates_grow_with_the_table(spark, tmp_path, monkeypatch, name):
    """Work on each document is dealt once, by the orders' keys, into as many parts as there are rows for; nothing deals it again."""
    spark.range(1000).selectExpr("id as o_orderkey", "id % 7 as o_custkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(synthetic, "PART", 50)
    parts = re.findall(r"Exchange hashpartitioning\((.*), (\d+)\)", plan_of(catalog.queries()[name](spark, str(tmp_path))))
    assert parts and {n for _, n in parts} == {"20"} and all(re.fullmatch(r"\w+#\d+L", k) for k, _ in parts)


def test_highlights_merge_over_islands_and_leave_empty_spans_out(spark):
    rows = [(1, "email", 0, 4), (1, "email", 4, 8), (1, "phone", 6, 10), (1, "phone", 20, 22), (1, "email", 30, 30), (1, "ipv4", 21, 25), (2, "email", 5, 5), (2, "email", None, None)]
    out = resolve.highlights(spark.createDataFrame(rows, "d long, kind string, start int, end int"), ["d"])
    assert sorted((r.d, r.kind, r.start, r.end) for r in out.collect()) == [(1, "email", 0, 6), (1, "ipv4", 22, 25), (1, "phone", 6, 10), (1, "phone", 20, 22)]


def test_windows_of_one_length_are_decoded_together(spark, monkeypatch):
    """The same spans as window by window, whatever lengths stand side by side and however few fit at once."""
    labels = ["O", "B-P", "I-P", "E-P", "B-Q", "E-Q"]
    r = np.random.default_rng(5)
    rows = [(i, "x y " * 9, [[k * 3, k * 3 + (k % 5 != 4) * 2] for k in range(n)], r.normal(size=(n, 6)).tolist()) for i, n in enumerate(r.integers(0, 12, 200).tolist())]
    plain = []
    for i, text, o, x in rows:
        x = np.array(x).reshape(-1, 6)
        tags = neural.decode_tags(x, labels, np.array([a < b for a, b in o], bool))
        p = [float(np.exp(v[labels.index(t)]) / np.exp(v).sum()) for v, t in zip(x, tags)]
        plain += [(i, *s) for s in neural.tag_spans(text, tags, o, p, 0.3)]
    monkeypatch.setattr(neural, "LOGITS", 200)
    schema = "d long, text string, offsets array<array<int>>, logits array<array<double>>"
    out = neural.decode(spark.createDataFrame(rows, schema).coalesce(1), ["d"], labels, 0.3)
    assert len(plain) > 50 and [tuple(v) for v in out.collect()] == plain
    sizes = []
    monkeypatch.setattr(neural, "decode_windows", lambda x, *a: sizes.append(x.shape) or np.zeros(x.shape[:2], np.int64))
    assert not list(neural.decoded(np.zeros((12, 2), np.int64), np.zeros((12, 6)), np.array([3, 2, 3, 0, 2, 2]), labels, 0.3))
    assert sizes == [(3, 2, 6), (2, 3, 6)]


def test_logits_of_another_width_are_an_error():
    for bad in ([[[0.0, 1.0], [1.0]]], [[[0.0, None]]], [None]):
        with pytest.raises(ValueError):
            neural._flat(pa.array(bad, pa.list_(pa.list_(pa.float64()))), 2, pa.float64())


def test_words_of_few_texts_are_held_at_once():
    assert [len(f) for f in model.few_at_once(iter([pd.Series(["A b", None] * 75), pd.Series(["c"])]))] == [64, 64, 22, 1]


def test_scans_join_sizes_not_texts(spark, tmp_path):
    spark.createDataFrame([(1, "a@b.cc"), (2, "é" * 2001), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = catalog.queries()["scan_status"](spark, str(tmp_path))
    assert {r.doc_id: r.status for r in out.collect()} == {1: "sensitive", 2: "unscannable", 3: "clean"}
    left = re.search(r"Join LeftOuter.*\n *:- (.*)", out._jdf.queryExecution().optimizedPlan().toString()).group(1)
    assert "octet_length" in left and not re.search(r"[\[ ]text#\d+[,\]]", left)


def test_shuffle_files_of_the_stages_go_with_their_query(spark):
    def kept() -> set[str]:
        return set(re.findall(r"shuffle_(\d+)_\d+_\d+\.data", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))

    before, own = kept(), small_batches(spark)
    own.range(1000).selectExpr("id % 7 as k").groupBy("k").count().write.format("noop").mode("overwrite").save()
    for _ in range(50):
        if not kept() - before:
            break
        time.sleep(0.2)
    assert not kept() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
