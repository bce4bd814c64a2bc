"""The relational part of the substring operators: which segments repeat, and which need a closer look.

Segments come from :mod:`pagewright.llm.anchors`.  A segment whose key occurs once can't repeat.  A
segment whose content (a BLAKE2b digest of 128 bits of its own bytes) occurs more than once repeats as a
whole.  What is left are the different contents under one key: one row for each goes to a
window-by-window comparison, with its text.  All joins and sums are keyed by hashes, so Spark splits or
pre-aggregates hot ones; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import segments
from .common import flat, partitions, slices, stage, tidy
from .hashing import digests

ROWS = "doc_id long, start int, count int, key long, content long, more long, twice boolean"
#: Contents of one key, and windows of them, that one task compares; keys with more are compared by window digests that
#: Spark deals out.
GROUP_MOST, GROUP_WINDOWS = 2000, 1 << 20


def segment_rows(documents: DataFrame, items: Callable, window: int, gram: int) -> DataFrame:
    """Segments of whole texts; ``items(data, offsets)`` gives (item hashes, first item of each document, bytes that
    spell the items, each item's first byte there, the byte behind each)."""

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            keys = batch.column("doc_id").to_numpy()
            for lo, hi in slices(offsets):
                h, first, spelt, begin, end = items(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                doc, start, count, key, twice = segments(h, first, window, gram)
                content = digests(spelt, begin[start], end[start + count + window - 2])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[lo + doc]), pa.array((start - first[doc]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(content[:, 0]), pa.array(content[:, 1]), pa.array(twice)],
                    ["doc_id", "start", "count", "key", "content", "more", "twice"],
                )

    return documents.mapInArrow(tidy(run), ROWS)


def repeated_keys(rows: DataFrame) -> DataFrame:
    """Keys that occur more than once, or whose windows may repeat inside one segment."""
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.max("twice").alias("twice")).where("n > 1 or twice").select("key")


def repeated(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments under those keys, their contents with the first place and the number of each)."""
    some = stage(rows.join(keys, "key"), "repeated")
    contents = some.groupBy("key", "content", "more").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start", "count")).alias("first"), F.max("twice").alias("twice"))
    return some, stage(contents, "contents")


def to_compare(contents: DataFrame) -> DataFrame:
    """One row for each content under a key with several contents, or whose windows may repeat inside it."""
    size = F.sum(F.col("first.count").cast("long"))
    keys = contents.groupBy("key").agg(F.count("*").alias("contents"), size.alias("windows"), F.max("twice").alias("any")).where("contents > 1 or any")
    common = (F.col("contents") > GROUP_MOST) | ((F.col("contents") > 1) & (F.col("windows") > GROUP_WINDOWS))
    return contents.join(keys, "key").select("key", "first.doc_id", "first.start", "first.count", "n", common.alias("common"))


def with_bodies(documents: DataFrame, compare: DataFrame, body: Callable) -> DataFrame:
    """Adds each row's text; ``body(data, lo, hi, start, count)`` gives the bytes of a document's segments."""
    by_doc = compare.groupBy("doc_id").agg(F.collect_list(F.struct("key", "start", "count", "n", "common")).alias("own"))  # bounded by the document

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            parts, size = [], 0
            for i, (doc, own) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("own"))):
                own = own.values
                bodies = body(data[offsets[i] : offsets[i + 1]], own.field("start").to_numpy(), own.field("count").to_numpy())
                parts.append(pa.RecordBatch.from_arrays([own.field("key"), pa.array(np.full(len(own), doc)), own.field("start"), own.field("count"), own.field("n"), own.field("common"), pa.array(bodies, pa.binary())], ["key", "doc_id", "start", "count", "n", "common", "body"]))
                size += parts[-1].nbytes
                if size >= 1 << 22:
                    yield from pa.Table.from_batches(parts).combine_chunks().to_batches()
                    parts, size = [], 0
            if parts:
                yield from pa.Table.from_batches(parts).combine_chunks().to_batches()

    return documents.join(by_doc, "doc_id").mapInArrow(tidy(run), "key long, doc_id long, start int, count int, n long, common boolean, body binary")


def by_key(frame: DataFrame) -> DataFrame:
    """Whole keys in one task, in order; only keys that aren't ``common`` come here, so a key is bounded."""
    return frame.repartition(partitions(frame.sparkSession), "key").sortWithinPartitions("key", "doc_id", "start")


def blocks(batches, most: int, whole: bool = True) -> Iterator[dict]:
    """Columns of consecutive rows, ``most`` bytes of bodies or little more; with ``whole`` no key is split."""
    kept: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_numpy()
        size = np.cumsum(np.diff(flat(batch.column("body"))[1]))
        if whole:
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            if kept and held >= most and kept[-1].column("key")[-1].as_py() != keys[0]:
                yield _block(kept)
                kept, held = [], 0
        else:
            cuts = np.arange(1, batch.num_rows + 1)
        lo = base = 0
        for cut, up in zip(cuts.tolist(), size[cuts - 1].tolist()):
            if held + up - base >= most:
                yield _block([*kept, batch.slice(lo, cut - lo)])
                kept, held, lo, base = [], 0, cut, up
        if lo < batch.num_rows:
            kept.append(batch.slice(lo))
            held += int(size[-1]) - base
    if kept:
        yield _block(kept)


def _block(parts: list[pa.RecordBatch]) -> dict:
    whole = pa.Table.from_batches(parts).combine_chunks()
    out = {c: whole.column(c).to_numpy() for c in ("doc_id", "start", "count", "n")}
    out["data"], out["offsets"] = flat(whole.column("body"))
    return out


def spans_by_document(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))  # bounded by the document
