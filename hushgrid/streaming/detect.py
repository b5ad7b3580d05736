"""Detection over a stream of texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.patterns import RULES, Rule
from ..operators import findings, resolve, spans


#: Reads the settings there are now: custom terms, and category policies (kind, action) or none.
Live = Callable[[], tuple[list[str], DataFrame | None]]


def detect_stream(texts: DataFrame, keys: list[str], text: str, out: str, checkpoint: str, rules: tuple[Rule, ...] = RULES, live: Live | None = None) -> None:
    """Run over what there is now: findings (keys, kind, n, ...) of each text, under ``out`` by batch.

    Texts are detected and resolved batch by batch; a batch that is run again replaces its own folder, so a restart
    after a failure leaves each text's findings once. ``live`` is asked once for each batch, so settings that change while
    the stream runs hold from the next batch on; where it fails the batch fails, as detection without settings would let
    through what they protect.
    """

    def one(batch: DataFrame, number: int) -> None:
        terms, policies = live() if live else ([], None)
        found = spans.detect(batch, keys, text, rules, terms)
        selected = resolve.select_spans(found if policies is None else resolve.with_policy(found, policies), keys)
        findings.findings(selected, keys).write.mode("overwrite").parquet(f"{out}/batch={number}")

    texts.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(one).start().awaitTermination()
