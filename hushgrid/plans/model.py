"""Registered queries of the model path: windows to spans with a model in the task, names that spans mean; each with its SQL."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import neural
from .catalog import register, t
from .gates import K, _filled, _filled_sql

LABELS = ["O", "B-PERSON", "I-PERSON", "E-PERSON"]
WORD = r"[^\x20\x09-\x0D]+"
#: Texts cut into words at a time.
AT_ONCE = 64


def cased_model():
    """A model that only knows two ids: 1 begins a name, 2 ends one; all else is outside. Ids 101, 102 and 0 are special."""

    def run(ids: np.ndarray, mask: np.ndarray, types: np.ndarray) -> tuple[np.ndarray, tuple[int, ...]]:
        x = np.zeros((*ids.shape, len(LABELS)))
        x[ids == 1, 1], x[ids == 2, 3] = 9.0, 9.0
        x[(ids == 3) | (mask == 0), 0] = 9.0
        return x.ravel(), x.shape

    return run


def words(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for x in texts:
        at = np.array([m.span() for m in re.finditer(WORD, x or "")], np.int32).reshape(-1, 2)
        capital = np.array(["A" <= x[a] <= "Z" for a in at[:, 0]], bool)
        after = np.concatenate([[False], capital[:-1]])[: len(at)]
        rows.append((np.where(capital, 1, np.where(after, 2, 3)).astype(np.int32), at[:, 0].copy(), at[:, 1].copy()))
    return pd.DataFrame(rows, columns=["ids", "starts", "ends"])


def few_at_once(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Words of ``AT_ONCE`` texts after another: a worker holds those of no whole Arrow batch."""
    for texts in frames:
        for i in range(0, len(texts), AT_ONCE):
            yield words(texts.iloc[i : i + AT_ONCE])


def cased_tokens(text):
    """ids, starts and ends of words: 1 for a capital first letter, 2 for a word after such a one, else 3."""

    @F.pandas_udf("ids array<int>, starts array<int>, ends array<int>")
    def cut(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return few_at_once(frames)

    return cut(text)


# The plain form: a capital word with the word after it, if that is none, wherever window bounds fall; what touches the
# first or last word goes where the text goes on beyond it.
@register("predicted_spans", f"""
    with w as (select doc_id, length(text) as n, list_transform(regexp_extract_all(text, '{WORD}'), lambda x: length(x)) as ls, regexp_extract_all(text, '{WORD}') as ws, string_split_regex(text, '{WORD}') as gs from documents),
      e as (select doc_id, n, i, len(ws) as words, ws[i] as word, ls[i] as size, length(gs[i]) as gap from (select *, unnest(range(1, len(ws) + 1)) as i from w)),
      p as (select doc_id, n, i, words, word, size, (sum(gap + size) over (partition by doc_id order by i))::int as stop, lead(word) over (partition by doc_id order by i) as after, lead(gap + size) over (partition by doc_id order by i) as more from e),
      s as (select *, after is not null and not regexp_matches(after, '^[A-Z]') as two from p where regexp_matches(word, '^[A-Z]')),
      r as (select doc_id, n, i, words, two, (stop - size)::int as a, (stop + case when two then more else 0 end)::int as b from s)
    select doc_id, a as start_at, b as end_at, 'PERSON' as label from r where not (i = 1 and a > 0) and not (i + two::int = words and b < n)""")
def predicted_spans(spark, sf_dir):
    """Spans of whole documents from a model that runs in the tasks, in windows of 256 tokens of which 64 are shared."""
    cut = t(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", cased_tokens(F.col("text")).alias("c")).select("doc_id", "text", "c.*")
    found = neural.predict(cut, ["doc_id"], LABELS, 0.5, cased_model, (101, 102, 0))
    return found.select("doc_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "label")


_REPAIRS = (
    # text, span of the model (by its text; from the end of the mark |), where it goes
    ("{k}，联系|张伟明，谢谢", 3, (0, 3)),
    ("{k}，欧|阳娜娜，谢谢", 3, (-1, 3)),
    ("{k}，请找|张伟明，谢谢", 5, (0, 3)),
    ("{k}，见|是张伟明，谢", 1, (1, 4)),
    ("{k}，见|的张伟明，谢", 1, (0, 1)),
    ("{k}，付|款单子，谢谢", 2, (0, 2)),
    ("{k}，，|，。张伟明，好", 5, (2, 5)),
)


def _repairs_sql() -> str:
    rows = []
    for i, (x, size, to) in enumerate(_REPAIRS):
        at = f"length({_filled_sql(x.split('|')[0])})"
        rows.append(f"select c_custkey as doc_id, {at}::int as from_start, ({at} + {size})::int as from_end, ({at} + {to[0]})::int as start_at, ({at} + {to[1]})::int as end_at from customer where c_custkey % {len(_REPAIRS)} = {i}")
    return " union all ".join(rows)


@register("repaired_people", _repairs_sql())
def repaired_people(spark, sf_dir):
    """Spans of people, too wide, too narrow or beside the name, moved to the one name that they mean."""
    text, at, size = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("int")
    for i, (x, n, _) in enumerate(_REPAIRS):
        head, tail = x.split("|")
        mine = K() % len(_REPAIRS) == i
        text = F.when(mine, F.concat(_filled(head, K()), F.lit(tail))).otherwise(text)
        at, size = F.when(mine, F.length(_filled(head, K()))).otherwise(at), F.when(mine, n).otherwise(size)
    d = t(spark, sf_dir, "customer").select(K().alias("doc_id"), text.alias("text"), at.alias("start"), (at + size).alias("end"))
    moved = neural.repair_people(d.select("doc_id", "start", "end"), d.select("doc_id", "text"), ["doc_id"])
    return moved.withColumnsRenamed({"start": "start_at", "end": "end_at"})
