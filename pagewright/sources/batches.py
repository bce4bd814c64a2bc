"""How much goes between Spark and a Python worker at once."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch between Spark and a Python worker: with both sides' copies, a task holds a few times as much.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, not only by rows, unless it has a closer bound."""
    now = re.fullmatch(r"(-?\d+)b?", spark.conf.get(_BATCH) or "")
    if now is None or not 0 < int(now[1]) <= BATCH_BYTES:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")
