"""Helpers that the operators of this subpackage share: reading, staging and Arrow access."""

from __future__ import annotations

import ctypes
import re
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.batches import BATCH_BYTES, small_batches  # noqa: F401

#: Bytes of text that a kernel handles at once; a longer document is handled alone, whole.
SLICE_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(frame: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key as long, text): a null text is the empty text; rows with a null key can't be named in
    a result and are left out.  Every other column is dropped here, so clashing names can't arise."""
    small_batches(frame.sparkSession)
    return frame.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text)
    )


def scratch(spark: SparkSession) -> str:
    """A folder that the driver and every executor share, for this application's own tables."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^,]*(,\s*\d+)?\])?", spark.sparkContext.master):  # local-cluster has machines of its own
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = "/tmp/checkpoints/pagewright"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def stage(frame: DataFrame, name: str) -> DataFrame:
    """Write the frame to the shared folder and read it back: lineage ends, and lost executors
    cost at most the tasks that were running."""
    spark = frame.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(frame.schema).parquet(path)
    back._staged_at = path
    return back


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of this application's own."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def unstage(*frames: DataFrame) -> None:
    """Delete tables that :func:`stage` wrote, once nothing reads them any more."""
    for frame in frames:
        removed(frame.sparkSession, frame._staged_at)


def give_back() -> None:
    """Give memory that is free, but that allocators keep, back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """A function for mapInArrow that gives memory back when its partition is done: workers are used again, by tasks of
    other operators too."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without nulls; offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes; each document lies whole in one range."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def crc_mod4(doc_id: Column) -> Column:
    """crc32 of the id written as text, modulo 4."""
    return F.crc32(doc_id.cast("string")) % 4


def one_per_id(frame: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows with unique ids: where rows repeat a doc_id, the one with the least text stays; null ids are left out.

    Gives :func:`keyed` rows, or the columns asked for.  Only ids are compared first, so tables that keep the rule
    pay no shuffle of texts."""
    small_batches(frame.sparkSession)
    rows = keyed(frame) if columns is None else frame.where(F.col("doc_id").isNotNull()).select(*columns)
    if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows
    others = [c for c in rows.columns if c != "doc_id"]
    least = F.min(F.struct(F.coalesce("text", F.lit("")).alias("_order"), *others)).alias("least")
    return rows.groupBy("doc_id").agg(least).select(*[F.col("doc_id") if c == "doc_id" else F.col(f"least.{c}") for c in rows.columns])


#: Ids that may be broadcast: 8 bytes each and a hash table of them, a few dozen MB.
BROADCAST_IDS = 1_000_000


def only(frame: DataFrame, ids: DataFrame, key: str = "doc_id", how: str = "left_semi") -> DataFrame:
    """The frame's rows whose key is among the (staged, distinct) ids, or with ``left_anti`` is not.

    Ids are broadcast if they are counted and few, so that texts need no shuffle; else Spark joins both sides by key."""
    return frame.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, how)


#: Rows under one key beyond which the key's other side is broadcast rather than dealt out by the key.
HOT = 10_000


def with_hot_keys(many: DataFrame, one: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """The rows of ``many`` with the columns of ``one``, which has each key once: an inner join that no hot key burdens.

    ``hot`` is a (staged) table of the keys with more than ``HOT`` rows in ``many``, so of at most one key for each ``HOT``
    rows.  They are counted, and if they are within ``BROADCAST_IDS``, their rows of ``one`` are broadcast; all other keys, and
    beyond that bound these too, are dealt out."""
    if not 0 < hot.count() <= BROADCAST_IDS:
        return many.join(one, key)
    marked = F.broadcast(hot.select(key))
    return many.join(F.broadcast(one.join(marked, key, "left_semi")), key).unionByName(many.join(marked, key, "left_anti").join(one.join(marked, key, "left_anti"), key))


def runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def covered(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Which of n places the ranges [lo, hi) cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    return np.cumsum(edge[:n]) > 0
