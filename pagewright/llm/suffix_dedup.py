"""Operator 1: removal of repeated byte strings by suffix arrays.

Content-defined segments (:mod:`pagewright.llm.anchors`) bring strings that may be equal together
without all pairs of shards.  A shard is a block of segments: its suffix array is made by
Larsson-Sadakane refinement in numpy (ranks over h bytes give ranks over 2h bytes, and only groups
that are still unsorted are sorted again), Kasai's inequality bounds the common prefixes of
neighbours, and suffixes that share ``window`` bytes form a class whose earliest member stays.
Segments of a very common key are dealt over several shards; their class representatives then meet
by window digest, and each shard's sorted run is merged into the others by binary search.  A segment
that is copied as a whole is settled before that, by the digest of its bytes.

Null text is empty; documents shorter than the window keep everything; where rows repeat a doc_id
the least text stands for it (one result row); rows with a null doc_id are left out; an empty table
gives an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import covered, flat, one_per_id, partitions, runs, stage, tidy, unstage
from .hashing import digests, mix, packed
from .repeats import blocks, by_key, repeated, repeated_keys, segment_rows, spans_by_document, to_compare, with_bodies

WINDOW, GRAM, SHARD, MERGED = 100, 20, 1 << 20, 1 << 19


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in the order of their first ``depth`` bytes, rank of each place), by Larsson-Sadakane refinement.

    A place's rank is the first slot of its group; groups of one need no more sorting."""
    n = len(data)
    first = packed(data)
    order = np.argsort(first, kind="stable")
    same = np.empty(n, bool)
    same[:1], same[1:] = False, first[order[1:]] == first[order[:-1]]
    slot = np.arange(n)
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(same, 0, slot))
    rank[n] = -1
    h = 8
    while h < depth:
        step = min(h, depth - h)
        alone = ~same
        alone[:-1] &= ~same[1:]
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        own = order[slots]
        key = (rank[own] << 32) + rank[np.minimum(own + step, n)] + 1
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[slots] = own
        equal = np.zeros(len(slots), bool)
        equal[1:] = key[1:] == key[:-1]
        same[slots] = equal
        new = np.maximum.accumulate(np.where(equal, 0, slots))
        rank[own] = new
        h += step
    return order, rank[:n]


def common_prefixes(data: np.ndarray, order: np.ndarray, limit: int, stride: int = 32) -> np.ndarray:
    """Common prefix (up to ``limit``) of each suffix with the one before it in the array.

    Kasai: going one place right in the text loses at most one byte.  Every ``stride``-th place is compared from
    the start; the others start from what the place before in the stride guarantees."""
    n = len(data)
    words = packed(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    found = np.zeros(n, np.int64)

    def extend(at: np.ndarray, least: np.ndarray) -> None:
        live, length = np.flatnonzero(before[at] >= 0), least.copy()
        while len(live):
            a, b = at[live] + length[live], before[at[live]] + length[live]
            inside = (a < n) & (b < n) & (length[live] < limit)
            live, a, b = live[inside], a[inside], b[inside]
            differ = words[a] ^ words[b]
            full = differ == 0
            part = live[~full]
            top = np.zeros(len(part), np.int64)
            d = differ[~full]
            for k in range(8):  # leading bytes that agree
                top += (d >> np.uint64(8 * (7 - k)) == 0) & (top == k)
            length[part] += top
            live = live[full]
            length[live] += 8
        found[at] = np.minimum(np.minimum(length, limit), n - np.maximum(at, before[at]))

    lead = np.arange(0, n, stride)
    extend(lead, np.zeros(len(lead), np.int64))
    for j in range(1, stride):
        at = lead + j
        at = at[at < n]
        extend(at, np.where(before[at] >= 0, np.maximum(found[at - 1] - 1, 0) * (before[at - 1] + 1 == before[at]), 0))
    return found[order]


def window_classes(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, place in the segment, class) of every window of the shard's segments, in suffix order."""
    order, _ = suffix_array(data, window)
    segment = np.searchsorted(offsets, order, "right") - 1
    whole = order + window <= offsets[segment + 1]
    breaks = common_prefixes(data, order, window) < window
    kind = np.cumsum(breaks)
    return segment[whole], (order - offsets[segment])[whole], kind[whole]


def shard_repeats(block: dict, window: int):
    """Windows of a shard by class: (segment, place, class start index, least (doc, place) first in each class)."""
    segment, place, kind = window_classes(block["data"], block["offsets"], window)
    doc, start = block["doc_id"][segment], block["start"][segment] + place
    by = np.lexsort((start, doc, kind))
    segment, place, kind = segment[by], place[by], kind[by]
    head = np.ones(len(kind), bool)
    head[1:] = kind[1:] != kind[:-1]
    return segment, place, head


def _later(batches, window: int, whole: bool = True):
    """(doc_id, lo, hi): bytes of segments under windows that start earlier elsewhere in their shard."""
    for block in blocks(batches, SHARD, whole):
        segment, place, head = shard_repeats(block, window)
        yield from marked(block, segment[~head], place[~head], window)


def marked(block: dict, segment: np.ndarray, place: np.ndarray, window: int):
    """Windows of segments as ranges of their documents."""
    sizes = np.diff(block["offsets"])
    flags = np.zeros(int(sizes.sum()) + len(sizes), bool)
    base = block["offsets"][:-1] + np.arange(len(sizes))  # a gap keeps segments' runs apart
    flags[base[segment] + place] = True
    lo, hi = runs(flags)
    of = np.searchsorted(base, lo, "right") - 1
    at = block["start"][of].astype(np.int64) - base[of]
    yield pa.RecordBatch.from_arrays([pa.array(block["doc_id"][of]), pa.array(lo + at), pa.array(hi + at + window - 1)], ["doc_id", "lo", "hi"])


def search(run: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted run by binary search, -1 where they aren't."""
    at = np.minimum(np.searchsorted(run, keys), max(len(run) - 1, 0))
    return np.where(run[at] == keys, at, -1) if len(run) else np.full(len(keys), -1)


def merge_runs(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each shard's sorted run (window, doc, place), whether each window starts earlier in any shard.

    Each run is merged into what earlier ones gave: windows are found there by binary search, new ones inserted."""
    known, best_doc, best_at = (np.zeros(0, np.int64) for _ in range(3))
    for w, doc, at in shards:
        new = w[search(known, w) < 0]
        to = np.searchsorted(known, new)
        known = np.insert(known, to, new)
        best_doc, best_at = (np.insert(x, to, np.iinfo(np.int64).max) for x in (best_doc, best_at))
        to = search(known, w)
        better = (doc < best_doc[to]) | ((doc == best_doc[to]) & (at < best_at[to]))
        best_doc[to[better]], best_at[to[better]] = doc[better], at[better]
    places = [search(known, w) for w, _, _ in shards]
    return [(best_doc[to] != doc) | (best_at[to] != at) for to, (_, doc, at) in zip(places, shards)]


def _window_rows(batches, window: int):
    """For very common keys: the digest and the earliest member of each class of a shard."""
    part, n = TaskContext.get().partitionId() << 32, 0
    for block in blocks(batches, SHARD, False):
        segment, place, head = shard_repeats(block, window)
        at = block["offsets"][segment[head]] + place[head]
        held = digests(block["data"].tobytes(), at, at + window)
        doc, start = block["doc_id"][segment], block["start"][segment].astype(np.int64) + place
        yield pa.RecordBatch.from_arrays([pa.array(held[:, 0]), pa.array(held[:, 1]), pa.array(np.full(len(held), part + n)), pa.array(doc[head]), pa.array(start[head])], ["one", "two", "shard", "doc_id", "at"])
        n += 1


def _merged(batches, window: int):
    """Later windows of a partition sorted by digest, as ranges; about MERGED rows are held at once."""
    kept: list[pa.RecordBatch] = []

    def merge():
        rows = pa.Table.from_batches(kept).combine_chunks()
        one, two, shard, doc, at = (rows.column(c).to_numpy() for c in ("one", "two", "shard", "doc_id", "at"))
        head = np.ones(len(one), bool)
        head[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        by = np.argsort(shard, kind="stable")  # each shard's windows in their own order
        own = np.split(by, np.flatnonzero(np.diff(shard[by])) + 1)
        number = np.cumsum(head)
        for i, later in zip(own, merge_runs([(number[i], doc[i], at[i]) for i in own])):
            yield pa.RecordBatch.from_arrays([pa.array(doc[i][later]), pa.array(at[i][later]), pa.array(at[i][later] + window)], ["doc_id", "lo", "hi"])

    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        one = batch.column("one").to_numpy()
        cuts = np.flatnonzero(one[1:] != one[:-1]) + 1
        if held >= MERGED and len(cuts):  # a window is never split
            kept.append(batch.slice(0, int(cuts[0])))
            yield from merge()
            kept, held, batch = [], 0, batch.slice(int(cuts[0]))
        kept.append(batch)
        held += batch.num_rows
    if kept:
        yield from merge()


SPANS = "doc_id long, lo long, hi long"


def _items(data: np.ndarray, offsets: np.ndarray):
    at = np.arange(len(data))
    return mix(data.astype(np.uint64)), offsets, data.tobytes(), at, at + 1


def removed_spans(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, lo, hi): byte ranges under strings of ``window`` bytes that start earlier, in any order, overlaps included."""

    def body(data, start, count):
        raw = data.tobytes()
        return [raw[s : s + c + window - 1] for s, c in zip(start.tolist(), count.tolist())]

    rows = stage(segment_rows(documents, _items, window, gram), "byte-segments")
    some, contents = repeated(rows, repeated_keys(rows))
    unstage(rows)
    again = contents.where("n > 1").select("key", "content", "more", F.col("first.doc_id").alias("first_doc"), F.col("first.start").alias("first_start"))
    copies = some.join(again, ["key", "content", "more"]).where("doc_id != first_doc or start != first_start")
    whole = copies.select("doc_id", F.col("start").cast("long").alias("lo"), (F.col("start") + F.col("count") + F.lit(window - 1)).cast("long").alias("hi"))
    compare = stage(to_compare(contents), "compare")
    found = by_key(with_bodies(documents, compare.where("not common"), body)).mapInArrow(tidy(lambda b: _later(b, window)), SPANS)
    out = whole.unionByName(found)
    common = compare.where("common")
    return out if common.isEmpty() else out.unionByName(common_key_spans(with_bodies(documents, common, body), window))


def common_key_spans(bodies: DataFrame, window: int) -> DataFrame:
    """The same for keys with very many contents: their segments are dealt out over shards, and shards are merged."""
    n = partitions(bodies.sparkSession)
    dealt = stage(bodies.repartition(n, "key", "doc_id").sortWithinPartitions("key", "doc_id", "start"), "common")
    within = dealt.mapInArrow(tidy(lambda b: _later(b, window, False)), SPANS)
    rows = dealt.mapInArrow(tidy(lambda b: _window_rows(b, window)), "one long, two long, shard long, doc_id long, at long")
    merged = rows.repartition(n, "one", "two").sortWithinPartitions("one", "two", "shard")
    return within.unionByName(merged.mapInArrow(tidy(lambda b: _merged(b, window)), SPANS))


def dedup(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept binary, spans of every document."""
    rows = one_per_id(documents)
    spans_of = spans_by_document(removed_spans(rows, window))

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            out = []
            for i, (lo, hi) in enumerate(zip(batch.column("lo"), batch.column("hi"))):
                own = data[offsets[i] : offsets[i + 1]]
                if lo.is_valid:
                    gone = covered(lo.values.to_numpy(), hi.values.to_numpy(), len(own))
                    a, b = runs(gone)
                    out.append((len(own), int(gone.sum()), len(a), own[~gone].tobytes(), np.stack([a, b], 1).tolist()))
                else:
                    out.append((len(own), 0, 0, own.tobytes(), []))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.list_(pa.int64())))))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    return rows.join(spans_of, "doc_id", "left").mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<array<long>>")


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
