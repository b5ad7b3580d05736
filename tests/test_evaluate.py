from pyspark.sql import functions as F

from hushgrid.operators import evaluate
from hushgrid.sources.scratch import scratch
from hushgrid.streaming.detect import detect_stream


def test_leaks_are_found_by_skeleton_and_by_value(spark):
    train = spark.createDataFrame([("请联系 张伟明！", ["张伟明"]), ("请联系：李建国", ["李建国"]), ("...", []), (None, ["only a value"]), ("plain", None)], "text string, values array<string>")
    rows = [
        (1, "请联系王小红。", ["王小红"], (True, False)), (2, "别联系王小红。", ["王小红"], None), (3, "another text", ["李建国"], (False, True)), (4, "请联系张伟明", ["张伟明"], (True, True)),
        (5, "!?", [], None), (6, None, ["x"], None), (7, "plain", None, (True, False)), (8, "pl-ain x.y", ["x.y", ""], (True, False)), (9, "only a value", ["only a value", None], (False, True)), (10, "plXain", ["x"], None),
        (11, "请联系王小红王小红", ["王小红"], (True, False)),
    ]
    asked = spark.createDataFrame([r[:3] for r in rows], "k int, text string, values array<string>")
    twice = asked.unionByName(asked)
    want = {r[0]: r[3] for r in rows if r[3]}
    for given in (asked, twice):
        got = evaluate.leaks(train, given, ["k"]).collect()
        assert {r.k: (r.same_context, r.same_value) for r in got} == want and len(got) == len(want)
    assert evaluate.leaks(train.limit(0), asked, ["k"]).count() == evaluate.leaks(train, asked.limit(0), ["k"]).count() == 0


def test_settings_hold_from_the_next_batch_on(spark, tmp_path):
    src, out, state = str(tmp_path / "in"), scratch(spark, "out"), scratch(spark, "state")
    now = {"terms": [], "policy": None}
    asked = []

    def live():
        asked.append(1)
        return now["terms"], spark.createDataFrame([("email", now["policy"])], "kind string, action string") if now["policy"] else None

    for key, terms, policy in ((1, [], None), (2, ["blue"], "block"), (3, [], "confirm")):
        now["terms"], now["policy"] = terms, policy
        spark.createDataFrame([(key, "blue a@example.com")], "k int, text string").coalesce(1).write.mode("append").parquet(src)
        detect_stream(spark.readStream.schema("k int, text string").parquet(src), ["k"], "text", out, state, live=live)
    got = sorted((r.k, r.kind, r.policy) for r in spark.read.parquet(out).select("k", "kind", F.coalesce("policy", F.lit("")).alias("policy")).collect())
    assert got == [(1, "email", ""), (2, "custom_term", ""), (2, "email", "block"), (3, "email", "confirm")] and len(asked) == 3
