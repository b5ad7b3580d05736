"""Session tokens as keyed state of a stream, and the latest draft of each session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import kinds

OUT = "session long, kind string, normalized string, n int"
STATE = "kinds array<string>, vals array<string>"


def stream_tokens(values: DataFrame) -> DataFrame:
    """New (session, kind, normalized, n) of a stream of (session, seq, kind, normalized, clear).

    State is the session's values in the order of their first appearance. A row with ``clear`` forgets them.
    Within a batch rows go by seq. Over MAX_TOKENS values are an error.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = list(zip(*state.get)) if state.exists else []
        seen, counts, out = set(known), {}, []
        for kind, _ in known:
            counts[kind] = counts.get(kind, 0) + 1
        rows = pd.concat(list(frames)).sort_values("seq")
        for kind, value, clear in zip(rows["kind"], rows["normalized"], rows["clear"]):
            if clear:
                known, seen, counts = [], set(), {}
                continue
            if (kind, value) in seen:
                continue
            if len(known) >= kinds.MAX_TOKENS:
                raise ValueError("session token capacity exceeded")
            known.append((kind, value))
            seen.add((kind, value))
            counts[kind] = counts.get(kind, 0) + 1
            out.append((key[0], kind, value, counts[kind]))
        state.update(([k for k, _ in known], [v for _, v in known]))
        yield pd.DataFrame(out, columns=["session", "kind", "normalized", "n"])

    return values.groupBy("session").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")


def latest_drafts(batch: DataFrame, session: str, at: str, text: str, longest: int = 5000) -> DataFrame:
    """The last draft of each session that is short enough to review; earlier ones are superseded."""
    last = batch.groupBy(session).agg(F.max_by(text, at).alias(text), F.max(at).alias(at))
    return last.where(F.length(text) <= longest)


def windowed_counts(events: DataFrame, at: str, width: str, late: str) -> DataFrame:
    """(start, event_type, n): counts in tumbling windows, rows later than ``late`` dropped by the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what there is now and write it as Parquet."""
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path).awaitTermination()


def run_complete(df: DataFrame, path: str, checkpoint: str) -> None:
    """Run an aggregating stream over what there is now; each batch replaces the whole result."""
    keep = lambda batch, _: batch.write.mode("overwrite").parquet(path)
    df.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
