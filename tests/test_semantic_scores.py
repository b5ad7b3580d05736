"""Scores of contexts: rows without known features or with nulls, repeated rows, and no join back of results."""

from hushgrid.operators import semantic


def test_every_context_has_a_score_without_a_join_back(spark):
    model = semantic.train(spark.createDataFrame([("a", True, "xy"), ("a", False, "z")], "kind string, positive boolean, context string"))
    rows = [(1, "a", "xy"), (2, "a", "qq"), (3, "a", None), (4, "b", "xy"), (5, "a", ""), (6, "a", "xy"), (6, "a", "xy"), (7, None, "xy")]
    out = semantic.score(spark.createDataFrame(rows, "id int, kind string, context string"), model)
    got = sorted((r.id, r.score > 0) for r in out.collect())
    assert got == [(1, True), (2, False), (3, False), (4, False), (5, False), (6, True), (6, True), (7, False)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1 and "Join Inner, ((id" not in plan
