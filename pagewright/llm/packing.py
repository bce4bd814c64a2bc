"""Operator 2: best-fit packing with large-item matching.

Texts become token ids once; documents longer than the capacity are cut (all pieces but the first
are full) and staged.  What is packed is the histogram of piece lengths, which has at most
``capacity`` entries whatever the corpus: pieces above a third of the capacity are matched
greedily, longest first, each with the longest other one that still fits (no sequence can hold
three); shorter pieces then go, longest first, into the fullest gap that holds them.  A plan is a
list of runs (length, first rank, number, first sequence, offset), and pieces join it by their
rank among pieces of their length, so nothing about documents passes through the driver.

A null text is empty: its document has one piece, the end token.  Rows with a null doc_id are left
out; repeated rows are packed as often as they occur; an empty table gives no pieces.  Other
columns are not looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import flat, keyed, stage, tidy
from .segments import library_ids

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long, ids binary"
PLAN = "length long, rank_lo long, n long, sequence_lo long, offset long"


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of n ids: the first may be shorter, the others are full."""
    short = n % capacity
    return ([short] if short else []) + [capacity] * (n // capacity)


def pieces(documents: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """A row for each piece, with its ids (little-endian unsigned 32-bit), the partition that made it and its
    place among that partition's pieces of the same length."""

    def run(batches):
        library, seen, part = library_ids(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            keys = batch.column("doc_id").to_pylist()
            for lo, ids, at in library.batches(data, offsets):
                rows = []
                for i in range(len(at) - 1):
                    own = np.append(ids[at[i] : at[i + 1]].astype("<u4"), np.uint32(end_id))
                    start = 0
                    for k, n in enumerate(cut_lengths(len(own), capacity)):
                        raw = own[start : start + n].tobytes()
                        rows.append((keys[lo + i], k, start, n, zlib.crc32(raw), part, int(seen[n]), raw))
                        seen[n] += 1
                        start += n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], [c.split()[0] for c in PIECES.split(", ")])

    return keyed(documents).mapInArrow(tidy(run), PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, number, first sequence, offset): piece number ``first rank + i`` of that length
    stands at ``offset`` of sequence ``first sequence + i``.  Work and result depend on the number of distinct
    lengths, not on the number of pieces."""
    out: list[tuple[int, int, int, int, int]] = []
    left, rank, sequences = dict(counts), dict.fromkeys(counts, 0), 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # free tokens -> [(first sequence, number)]
    order: list[int] = []  # the free sizes that occur, ascending

    def free(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not gaps.get(gap):
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n))

    def put(length: int, n: int, first: int, offset: int) -> None:
        out.append((length, rank[length], n, first, offset))
        rank[length] += n
        left[length] -= n

    large = sorted((s for s in counts if 3 * s > capacity), reverse=True)
    for s in large:
        while left[s]:
            mate = next((t for t in large if t <= capacity - s and left[t] and (t != s or left[t] > 1)), None)
            if mate is None:
                n = left[s]
                put(s, n, sequences, 0)
                free(capacity - s, sequences, n)
            else:
                n = min(left[s], left[mate]) if mate != s else left[s] // 2
                put(s, n, sequences, 0)
                put(mate, n, sequences, s)
                free(capacity - s - mate, sequences, n)
            sequences += n
    for s in sorted((s for s in counts if 3 * s <= capacity), reverse=True):
        while left[s]:
            k = bisect_left(order, s)
            if k == len(order):  # no gap holds it: open sequences, each with as many of this length as fit
                fit = capacity // s
                n = -(-left[s] // fit)
                first, sequences = sequences, sequences + n
                for j in range(fit):
                    m = min(n, left[s])
                    if m:
                        put(s, m, first, j * s)
                    full = min(n, left[s])  # the sequences that get one more
                    free(capacity - (j + 1) * s, first + full, m - full)
                continue
            gap = order[k]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del order[k]
            m = min(n, left[s])
            put(s, m, first, capacity - gap)
            free(gap - s, first, m)
            free(gap, first + m, n - m)
    return out


def pack(documents: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids (binary, little-endian unsigned 32-bit)."""
    spark = documents.sparkSession
    made = stage(pieces(documents, path, capacity, end_id), "pieces")
    return place(spark, made, capacity)


def place(spark, made: DataFrame, capacity: int) -> DataFrame:
    """Give staged pieces their sequences."""
    # Sums by (partition, length): at most ``capacity`` rows for each partition of the scan.
    sums = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = sums.select(
        "part", "length", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    )
    totals = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    runs = spark.createDataFrame(plan(totals, capacity), PLAN)
    ranked = made.join(before, ["part", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    # The plan's size is bounded by the capacity (a few thousand runs of 40 bytes), not by the corpus.
    runs = F.broadcast(runs.withColumnRenamed("length", "of"))
    fits = (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("rank_lo")) & (F.col("rank") < F.col("rank_lo") + F.col("n"))
    return ranked.join(runs, fits).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence_lo") + F.col("rank") - F.col("rank_lo")).alias("sequence_id"), "offset", "ids"
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids binary): each packed sequence's tokens; a group holds at most ``capacity`` of them."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(rows, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
