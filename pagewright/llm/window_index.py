"""Operator 9: substring dedup with a log-structured fingerprint index.

Every window of ``window`` words selects one fingerprint, the least hash of its grams
(:mod:`pagewright.llm.anchors`); neighbouring windows that select the same one form a segment.  The index
keeps sorted immutable runs of fingerprints, each with how often it occurred: bucketed tables, so that
runs meet in a merge join without a shuffle.  A batch of documents becomes a run and is merge-joined with
every earlier run; runs are merged into one when there are more than ``MOST_RUNS``.  The fingerprints
that repeat, within a batch or between a batch and the history, lead to candidates, which are verified by
their words: segments by a BLAKE2b digest of 128 bits of the words they hold, and different segments with
one fingerprint window by window, by names that are equal only for equal words.

A word is removed if any window of ``window`` words that covers it occurs more than once.  Null and
short texts keep everything; where rows repeat a doc_id the least text stands for it (one result
row); rows with a null doc_id are left out; an empty table gives an empty result.  Other columns
are looked at only if they are asked for (``carry``).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import covered, flat, one_per_id, partitions, removed, runs, scratch, stage, tidy, unstage
from .hashing import digests, names, window_names, words
from .repeats import blocks, by_key, repeated, segment_rows, spans_by_document, to_compare, with_bodies

WINDOW, GRAM, MOST_RUNS, BATCHES, BLOCK = 35, 6, 2, 4, 1 << 20
SPANS = "doc_id long, lo long, hi long"


def spelt(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with one space between them: (bytes, starts, ends)."""
    size = end - start
    to = np.cumsum(size + 1) - size - 1
    out = np.full(int((size + 1).sum()), 0x20, np.uint8)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[at + np.repeat(to, size)] = data[at + np.repeat(start, size)]
    return out, to, to + size


def _items(data: np.ndarray, offsets: np.ndarray):
    start, end, h, first = words(data, offsets)
    raw, start, end = spelt(data, start, end)
    return h, first, raw.tobytes(), start, end


class FingerprintIndex:
    """Sorted runs of (key, n, twice) under a folder that the cluster shares: how often each window fingerprint occurred,
    and whether windows of one segment may repeat each other."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{scratch(spark)}/window-index-{uuid.uuid4().hex}"
        self.buckets = partitions(spark)
        self.runs: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"pagewright_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.folder}/{name}").option("compression", "zstd").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        removed(self.spark, f"{self.folder}/{name}")

    def run(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def add(self, segments: DataFrame) -> DataFrame:
        """One more batch of segments becomes a run.  Returns the fingerprints that repeat in it or that the history has: the
        run's merge join with each earlier run.  Runs are compacted when there are too many."""
        new = self._write(segments.groupBy("key").agg(F.count("*").alias("n"), F.max("twice").alias("twice")))
        rows = self.run(new)
        hits = rows.where("n > 1 or twice").select("key")
        for old in self.runs:
            hits = hits.unionByName(rows.join(self.run(old), "key", "left_semi").select("key"))
        hits = stage(hits, "hits")
        self.runs.append(new)
        if len(self.runs) > MOST_RUNS:
            self.compact()
        return hits

    def compact(self) -> None:
        """Merge all runs into one and delete them."""
        if len(self.runs) < 2:
            return
        old, self.runs = self.runs, [self._write(self.rows().groupBy("key").agg(F.sum("n").alias("n"), F.max("twice").alias("twice")))]
        for name in old:
            self._drop(name)

    def rows(self) -> DataFrame:
        """All runs' rows, read as plain files: a union of bucketed tables must not pass for bucketed."""
        return self.spark.read.schema(self.run(self.runs[0]).schema).parquet(*[f"{self.folder}/{name}" for name in self.runs])

    def delete(self) -> None:
        while self.runs:
            self._drop(self.runs.pop())


def _body(data: np.ndarray, start: np.ndarray, count: np.ndarray, window: int) -> list[bytes]:
    a, b, _, _ = words(data, np.array([0, len(data)]))
    raw = data.tobytes()
    return [raw[lo:hi] for lo, hi in zip(a[start].tolist(), b[start + count + window - 2].tolist())]


def block_windows(block: dict):
    """(first byte, byte behind, index of each segment's first word) of the block's words; (segment, place, first word) of
    every window of its segments."""
    start, end, _, first = words(block["data"], block["offsets"])
    count = block["count"].astype(np.int64)
    begin = np.cumsum(count) - count
    segment = np.repeat(np.arange(len(count)), count)
    place = np.arange(int(count.sum())) - begin[segment]
    return start, end, segment, place, first[segment] + place


def _repeats(batches, window: int):
    """(doc_id, lo, hi): words under windows that occur more than once in their key's group.

    Contents that occur more than once are marked elsewhere as a whole; here they only count."""
    for block in blocks(batches, BLOCK):
        start, end, segment, place, at = block_windows(block)
        kind = np.unique(window_names(names(block["data"], start, end), window)[at], return_inverse=True)[1]
        times = np.bincount(kind, weights=block["n"][segment].astype(np.float64))
        mark = (times[kind] > 1) & (block["n"][segment] == 1)
        sizes = block["count"].astype(np.int64) + 1  # a gap keeps segments' runs apart
        base = np.cumsum(sizes) - sizes
        flags = np.zeros(int(sizes.sum()), bool)
        flags[base[segment[mark]] + place[mark]] = True
        lo, hi = runs(flags)
        of = np.searchsorted(base, lo, "right") - 1
        to = block["start"][of] - base[of]
        yield pa.RecordBatch.from_arrays([pa.array(block["doc_id"][of]), pa.array(lo + to), pa.array(hi + to + window - 1)], ["doc_id", "lo", "hi"])


def _digest_rows(batches, window: int):
    for block in blocks(batches, BLOCK, False):
        start, end, segment, place, at = block_windows(block)
        raw, start, end = spelt(block["data"], start, end)
        held = digests(raw.tobytes(), start[at], end[at + window - 1])
        yield pa.RecordBatch.from_arrays([pa.array(held[:, 0]), pa.array(held[:, 1]), pa.array(block["n"][segment]), pa.array(block["doc_id"][segment]), pa.array(block["start"][segment] + place)], ["one", "two", "n", "doc_id", "at"])


def removed_spans(documents: DataFrame, segments: DataFrame, keys: DataFrame, window: int) -> DataFrame:
    """(doc_id, lo, hi): words under windows that occur more than once, among the segments with those fingerprints."""
    some, contents = repeated(segments, keys)
    again = contents.where("n > 1").select("key", "content", "more")
    whole = some.join(again, ["key", "content", "more"]).select("doc_id", F.col("start").cast("long").alias("lo"), (F.col("start") + F.col("count") + F.lit(window - 1)).cast("long").alias("hi"))
    compare = stage(to_compare(contents), "compare")
    body = lambda data, start, count: _body(data, start, count, window)
    found = by_key(with_bodies(documents, compare.where("not common"), body)).mapInArrow(tidy(lambda b: _repeats(b, window)), SPANS)
    out = whole.unionByName(found)
    common = compare.where("common")
    if common.isEmpty():
        return out
    # Very common keys: windows meet by their own digests, which Spark pre-aggregates and deals out.
    dealt = with_bodies(documents, common, body).repartition(partitions(documents.sparkSession), "key", "doc_id").sortWithinPartitions("key")
    each = stage(dealt.mapInArrow(tidy(lambda b: _digest_rows(b, window)), "one long, two long, n long, doc_id long, at long"), "window-digests")
    twice = each.groupBy("one", "two").agg(F.sum("n").alias("times")).where("times > 1").select("one", "two")
    hit = each.where("n = 1").join(twice, ["one", "two"]).select("doc_id", F.col("at").alias("lo"), (F.col("at") + window).alias("hi"))
    return out.unionByName(hit)


def batch_of(doc_id, batches: int):
    return F.pmod(F.xxhash64(doc_id), F.lit(batches))


def dedup(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept string, spans (of words) for every document, and the columns of ``carry``; the index
    takes the documents in batches, each one's matches with the history and itself before the next."""
    rows = one_per_id(documents, list(dict.fromkeys(["doc_id", "text", *carry])) if carry else None).withColumn("text", F.coalesce("text", F.lit("")))
    texts = rows.select("doc_id", "text")
    index = FingerprintIndex(rows.sparkSession)
    segments = stage(segment_rows(texts, _items, window, gram), "word-segments")
    hits = [index.add(segments.where(batch_of("doc_id", batches) == k)) for k in range(batches)]
    keys = hits[0]
    for more in hits[1:]:
        keys = keys.unionByName(more)
    index.delete()
    spans_of = spans_by_document(removed_spans(texts, segments, keys.distinct(), window))
    unstage(segments, *hits)
    extra = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in carry]

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            out = []
            for i, (lo, hi) in enumerate(zip(batch.column("lo"), batch.column("hi"))):
                own = data[offsets[i] : offsets[i + 1]]
                a, b, _, _ = words(own, np.array([0, len(own)]))
                gone = covered(lo.values.to_numpy(), hi.values.to_numpy(), len(a)) if lo.is_valid else np.zeros(len(a), bool)
                out.append((len(a), int(gone.sum()), spelt(own, a[~gone], b[~gone])[0].tobytes()[:-1], np.stack(runs(gone), 1).tolist()))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))))), *(batch.column(c) for c in carry)],
                ["doc_id", "n_words", "n_removed", "kept", "spans", *carry],
            )

    return rows.join(spans_of, "doc_id", "left").mapInArrow(tidy(run), ", ".join(["doc_id long, n_words long, n_removed long, kept string, spans array<array<long>>", *extra]))


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
