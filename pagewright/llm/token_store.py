"""Operator 5: a content-addressed store of token ids.

Writing: every document's ids are cut into chunks where a rolling hash over the last
``WINDOW`` ids hits a mask (so equal passages give equal chunks wherever they stand), chunks are
named by their SHA-256 digest and stored once, and a recipe lists each document's chunks in order.
Reading: every stored chunk is read back, its digest and its crc32 are computed anew, and recipes
are followed: a document's checksum is combined from its chunks' checksums, and its Merkle root
from their digests, so documents aren't gathered byte by byte.  The manifest holds the root over
documents of each recipe partition, in ascending doc_id order, and the store's root over those.

Null text is empty (the end id only); rows with a null doc_id are left out; rows that repeat a
doc_id keep one recipe each; an empty table gives an empty store.  Other columns
are not looked at.

Format, under one folder: ``chunks`` (digest, n, body: ids in little-endian units of 2 or 4 bytes),
``recipes`` (part, doc_id, row, start, n_tokens, root, chunks), ``manifest`` (part, n_docs, n_tokens, root).
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import flat, keyed, partitions, scratch, stage, tidy, unstage
from .hashing import grams, mix
from .segments import library_ids

WINDOW, MEAN, LEAST, MOST = 16, 1024, 64, 8192


def cut_places(ids: np.ndarray) -> np.ndarray:
    """Places behind an id where the rolling hash of the last WINDOW ids hits the mask, ascending."""
    if len(ids) < WINDOW:
        return np.zeros(0, np.int64)
    return np.flatnonzero((grams(mix(ids.astype(np.uint64) + np.uint64(1)), WINDOW) & np.uint64(MEAN - 1)) == 0) + WINDOW


def chunk_ends(places: np.ndarray, lo: int, hi: int) -> list[int]:
    """Ends of the chunks of the document [lo, hi): at places at least LEAST and at most MOST ids apart, and at hi.

    No place within the first LEAST ids counts, so a hash that reaches back into the document before never does."""
    ends, last = [], lo
    for h in [*places[np.searchsorted(places, lo + LEAST) : np.searchsorted(places, hi)].tolist(), hi]:
        while h - last > MOST:
            last += MOST
            ends.append(last)
        if h - last >= LEAST or (h == hi and h > last):
            ends.append(h)
            last = h
    return ends


def _merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up as it is."""
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


@lru_cache(100_000)
def _power(n: int) -> int:
    """x**(8n) modulo the crc32 polynomial (reflected): what n more bytes multiply a checksum by."""
    power, base = 1 << 31, 1 << 23  # 1, and x**8
    while n:
        if n & 1:
            power = _times(power, base)
        base, n = _times(base, base), n >> 1
    return power


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 0x80000000:
            out ^= a
        b = (b << 1) & 0xFFFFFFFF
        a = (a >> 1) ^ (0xEDB88320 if a & 1 else 0)
    return out


def combine(crc: int, more: int, n: int) -> int:
    """crc32 of two stretches one after the other, the second of n bytes."""
    return _times(crc, _power(n)) ^ more


def _times_each(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """:func:`_times` of many pairs of polynomials at once."""
    a, b, out = a.astype(np.uint32), b.astype(np.uint32), np.zeros(len(a), np.uint32)
    one, top, poly = np.uint32(1), np.uint32(31), np.uint32(0xEDB88320)
    for _ in range(32):
        out ^= a * (b >> top)
        b = b << one
        a = (a >> one) ^ (poly * (a & one))
    return out


@lru_cache(1)
def _powers() -> np.ndarray:
    """:func:`_power` of the bytes of 0, 1, ... MOST ids."""
    n, out, base = np.arange(MOST + 1), np.full(MOST + 1, 1 << 31, np.uint32), _power(4)
    for k in range(MOST.bit_length()):
        odd = n >> k & 1 == 1
        out[odd] = _times_each(out[odd], np.full(int(odd.sum()), base, np.uint32))
        base = _times(base, base)
    return out


def combine_each(crcs: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """crc32 of each stretch of chunks [at[i], at[i + 1]) from its chunks' checksums and numbers of ids; 0 for none.

    The first chunks of all stretches are combined with the second ones, these with the third, and so on; the few stretches
    that are left with many chunks go one by one."""
    size, crcs = np.diff(at), crcs.astype(np.uint32)
    out = np.zeros(len(size), np.uint32)
    left, k = np.flatnonzero(size > 0), 1
    out[left] = crcs[at[left]]
    while len(left := left[size[left] > k]) > 16 and n.max() <= MOST:
        place = at[left] + k
        out[left] = _times_each(out[left], _powers()[n[place]]) ^ crcs[place]
        k += 1
    for i in left.tolist():
        crc = int(out[i])
        for place in range(int(at[i]) + k, int(at[i + 1])):
            crc = combine(crc, int(crcs[place]), 4 * int(n[place]))
        out[i] = crc
    return out.astype(np.int64)


CHUNKS = "doc_id long, row long, k int, n long, digest binary, body binary"


def chunked(documents: DataFrame, path: str, end_id: int) -> DataFrame:
    """A row for each chunk of each document."""

    def run(batches):
        library, row = library_ids(path), TaskContext.get().partitionId() << 33
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            keys = batch.column("doc_id").to_pylist()
            for lo, ids, at in library.batches(data, offsets):
                rows = []
                at = at + np.arange(len(at))  # each document's end id takes a place
                own = np.full(at[-1], end_id, library.unit)
                kept = np.ones(at[-1], bool)
                kept[at[1:] - 1] = False
                own[kept] = ids
                places = cut_places(own)
                for i, (last, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    row += 1
                    for k, e in enumerate(chunk_ends(places, last, hi)):
                        body = own[last:e].tobytes()
                        rows.append((keys[lo + i], row, k, e - last, hashlib.sha256(body).digest(), body))
                        last = e
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["doc_id", "row", "k", "n", "digest", "body"])

    return keyed(documents).mapInArrow(tidy(run), CHUNKS)


def _root(chunks):
    import pandas as pd

    return pd.Series([_merkle([bytes(d) for d in own]) for own in chunks], dtype=object)


def write(documents: DataFrame, path: str, folder: str, end_id: int = 2) -> None:
    """Write the store to a folder that the cluster shares."""
    made = stage(chunked(documents, path, end_id), "chunks")
    made.groupBy("digest").agg(F.first("n").alias("n"), F.first("body").alias("body")).write.option("compression", "zstd").parquet(f"{folder}/chunks")
    # A recipe is bounded by its own document; doc_id ranges give the order on disk.
    own = made.groupBy("doc_id", "row").agg(F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("k", "digest"))).alias("c"))
    own = own.select("doc_id", "row", "n_tokens", F.col("c.digest").alias("chunks"))
    ordered = own.repartitionByRange(partitions(made.sparkSession), "doc_id", "row").sortWithinPartitions("doc_id", "row").withColumn("part", F.spark_partition_id())
    raw = stage(ordered, "recipes")
    sums = raw.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"))
    # One row for each partition of the recipes, so the ordered running sum is small.
    base = sums.select("part", F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    root = F.pandas_udf(_root, "binary")
    placed = raw.join(base, "part").select(
        "part", "doc_id", "row", (F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("start"), "n_tokens", root("chunks").alias("root"), "chunks"
    )
    placed.sortWithinPartitions("part", "doc_id", "row").write.parquet(f"{folder}/recipes")

    def manifest(batches):
        """Partial roots; documents of one part may come in several batches, so leaves are kept by part."""
        leaves: dict[int, list] = {}
        tokens: dict[int, int] = {}
        for batch in batches:
            for part, n, leaf in zip(*(batch.column(c).to_pylist() for c in ("part", "n_tokens", "root"))):
                leaves.setdefault(part, []).append(leaf)
                tokens[part] = tokens.get(part, 0) + n
        parts = sorted(leaves)
        yield pa.RecordBatch.from_arrays(
            [pa.array(parts, pa.int32()), pa.array([len(leaves[p]) for p in parts], pa.int64()), pa.array([tokens[p] for p in parts], pa.int64()), pa.array([_merkle(leaves[p]) for p in parts], pa.binary())],
            ["part", "n_docs", "n_tokens", "root"],
        )

    stored = made.sparkSession.read.parquet(f"{folder}/recipes")
    by_part = stored.select("part", "doc_id", "row", "n_tokens", "root").repartition("part").sortWithinPartitions("part", "doc_id", "row")
    by_part.mapInArrow(tidy(manifest), "part int, n_docs long, n_tokens long, root binary").write.parquet(f"{folder}/manifest")
    unstage(made, raw)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ``verified`` (chunk digests and the document's Merkle root agree
    with what was read), from the files alone."""

    def check(batches):
        for batch in batches:
            digests, crcs, good = [], [], []
            for n, digest, body in zip(*(batch.column(c).to_pylist() for c in ("n", "digest", "body"))):
                ids = np.frombuffer(body, "<u2" if len(body) == 2 * n else "<u4")
                digests.append(digest)
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                good.append(hashlib.sha256(body).digest() == digest and len(ids) == n)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), batch.column("n"), pa.array(crcs, pa.int64()), pa.array(good, pa.bool_())], ["digest", "n", "crc", "good"])

    stored = spark.read.parquet(f"{folder}/chunks").mapInArrow(tidy(check), "digest binary, n long, crc long, good boolean")
    recipes = spark.read.parquet(f"{folder}/recipes")
    steps = recipes.select("doc_id", "row", "start", "n_tokens", "root", F.posexplode("chunks").alias("k", "digest"))
    got = steps.join(stored, "digest").groupBy("doc_id", "row", "start", "n_tokens", "root").agg(F.array_sort(F.collect_list(F.struct("k", "n", "crc", "digest", "good"))).alias("c"))

    def follow(batches):
        for batch in batches:
            chunks = batch.column("c")
            own = chunks.flatten()
            at = np.append(0, np.cumsum(pc.list_value_length(chunks).to_numpy(zero_copy_only=False)))
            n, digests, whole = own.field("n").to_numpy(), own.field("digest").to_pylist(), own.field("good").to_numpy(zero_copy_only=False)
            crcs = combine_each(own.field("crc").to_numpy(), n, at)
            sums, bad = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(~whole))
            fits = (bad[at[1:]] == bad[at[:-1]]) & (sums[at[1:]] - sums[at[:-1]] == batch.column("n_tokens").to_numpy())
            good = [ok and _merkle(digests[lo:hi]) == root for ok, lo, hi, root in zip(fits.tolist(), at[:-1].tolist(), at[1:].tolist(), batch.column("root").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crcs), pa.array(good, pa.bool_())], ["doc_id", "start", "n_tokens", "ids_crc32", "verified"])

    return got.mapInArrow(tidy(follow), "doc_id long, start long, n_tokens long, ids_crc32 long, verified boolean")


def new_folder(spark: SparkSession) -> str:
    return f"{scratch(spark)}/token-store-{uuid.uuid4().hex}"


def root(spark: SparkSession, folder: str) -> str:
    """The store's root: over the roots of its recipe partitions, one row each."""
    rows = spark.read.parquet(f"{folder}/manifest").select("part", "root").collect()
    return _merkle([bytes(r["root"]) for r in sorted(rows)]).hex()
