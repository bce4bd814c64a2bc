"""Arriving pages: triage of each micro-batch of line boxes (an addition; the batch operators are unchanged)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.triage import Thresholds, triage


def triage_stream(boxes: DataFrame, out: str, checkpoint: str, thresholds: Thresholds = Thresholds()) -> StreamingQuery:
    """Verdicts of whole files in each batch, written once per batch: a batch that runs again overwrites its own folder."""

    def each(batch: DataFrame, number: int) -> None:
        triage(batch, thresholds).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return boxes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
