"""The model path: windows, shapes, whole prediction against the plain form; names that spans mean."""

import numpy as np
import pytest

from hushgrid.operators import neural
from hushgrid.plans.model import LABELS, cased_model

SCHEMA = "k long, text string, ids array<int>, starts array<int>, ends array<int>"
SPECIAL = (101, 102, 0)


def tokens(words):
    at, out = 0, []
    for w in words:
        out.append((at, at + len(w)))
        at += len(w) + 1
    return " ".join(words), out


def plain(text, ids, offsets, width, stride):
    """Window by window, without Spark."""
    if not ids:
        return []
    cap, model, found, start = width - 2, cased_model(), [], 0
    while True:
        end = min(start + cap, len(ids))
        x = np.reshape(model(*neural.padded_batch(np.array(ids[start:end]), SPECIAL, width))[0], (width, len(LABELS)))
        offs = [(0, 0), *offsets[start:end], *[(0, 0)] * (width - 1 - (end - start))]
        tags = neural.decode_tags(x, LABELS, np.array([a < b for a, b in offs]))
        p = np.exp(x - x.max(axis=1, keepdims=True))
        p = p[np.arange(width), [LABELS.index(t) for t in tags]] / p.sum(axis=1)
        lo, hi = offsets[start][0], offsets[end - 1][1]
        found += [s for s in neural.tag_spans(text, tags, offs, list(p), 0.5) if not (s[0] <= lo and lo > 0 or s[1] >= hi and hi < len(text))]
        if end == len(ids):
            break
        start += cap - stride
    kept = []
    for s in sorted(set(found), key=lambda s: (s[0] - s[1], s[0], s[2])):
        if not any(s[0] < k[1] and k[0] < s[1] for k in kept):
            kept.append(s)
    return sorted(kept)


@pytest.mark.parametrize("width, stride", [(8, 2), (10, 0), (256, 64)])
def test_prediction_equals_the_plain_form(spark, width, stride):
    rng = np.random.default_rng(width)
    rows = []
    for k, n in enumerate([0, 1, 5, 6, 7, 12, 13, 60, 254, 255, 700]):
        text, offs = tokens(["é" * int(rng.integers(1, 4)) for _ in range(n)])
        ids = rng.choice([1, 2, 3], n, p=[0.3, 0.4, 0.3]).tolist()
        rows.append((k, text + ("  " if k % 2 else ""), ids, offs))
    flat = [(k, x, i, [a for a, _ in o], [b for _, b in o]) for k, x, i, o in rows]
    given = spark.createDataFrame(flat, SCHEMA).repartition(3)
    got = {}
    for r in neural.predict(given, ["k"], LABELS, 0.5, cased_model, SPECIAL, width, stride).collect():
        got.setdefault(r.k, []).append((r.start, r.end, r.label))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, t, i, o in rows if (v := plain(t, i, o, width, stride))}
    assert neural.predict(given.limit(0), ["k"], LABELS, 0.5, cased_model, SPECIAL, width, stride).count() == 0


def test_shapes():
    ids, mask, types = neural.padded_batch(np.array([7, 8]), SPECIAL, 6)
    assert ids.tolist() == [[101, 7, 8, 102, 0, 0]] and mask.tolist() == [[1, 1, 1, 1, 0, 0]] and types.shape == (1, 6)
    assert neural.logits_rows(np.arange(12.0), (1, 3, 4))[0, 2].tolist() == [8, 9, 10, 11]
    for data, dims in ((np.arange(11.0), (1, 3, 4)), (np.arange(12.0), (3, 4)), (np.arange(0.0), (1, 0, 4)), (np.arange(12.0), (1, 1.5, 8)), (np.arange(12.0), (-1, -3, 4))):
        with pytest.raises(ValueError):
            neural.logits_rows(data, dims)


def test_a_model_of_another_shape_is_an_error(spark):
    given = spark.createDataFrame([(1, "a b", [1, 2], [0, 2], [1, 3])], SCHEMA)
    with pytest.raises(Exception, match="another shape"):
        neural.predict(given, ["k"], LABELS[:2], 0.5, cased_model, SPECIAL, 8, 2).collect()


def test_people_are_repaired_to_the_one_name(spark):
    cases = [
        ("联系张伟明，谢谢", 2, 5, (2, 5)), ("联系张伟明，谢谢", 3, 5, (2, 5)), ("联系张伟明，谢谢", 2, 7, (2, 5)), ("某方是张伟明", 1, 3, (3, 6)), ("某方的张伟明", 1, 3, (1, 3)),
        ("张伟明，李建国", 0, 7, (0, 7)), ("张伟明", 0, 3, (0, 3)), ("付款单", 0, 2, (0, 2)), ("", 0, 0, (0, 0)), (None, 0, 2, None),
    ]
    texts = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, text string")
    spans = spark.createDataFrame([(k, c[1], c[2]) for k, c in enumerate(cases)] + [(0, 2, 5)], "k int, start int, end int")
    rows = neural.repair_people(spans, texts, ["k"]).collect()
    assert {r.k: (r.start, r.end) for r in rows} == {k: c[3] for k, c in enumerate(cases) if c[3]} and len(rows) == 9
    assert neural.repair_people(spans.limit(0), texts, ["k"]).count() == 0
