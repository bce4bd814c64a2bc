"""Operator 3: homomorphic multiset fingerprints of documents.

A document is the multiset of its paragraphs (lines).  Each paragraph hashes to a wide vector, and
the document's fingerprint is the sum of those vectors modulo powers of two, so order doesn't
matter and paragraphs are inserted and deleted by adding and subtracting.  Two halves: ``EXACT``
lanes of 64 random bits modulo 2**64 for equality, and ``SIGNS`` lanes modulo 2**32 of plus or minus
one for each of a paragraph's stretches of ``UNIT`` words, whose products estimate what two documents share.

Null text is empty; an empty text has the zero fingerprint; rows with a null doc_id are left out;
rows that repeat a doc_id follow each other by text; a table of one document is its own
successor; an empty table gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, partitions, tidy

EXACT, SIGNS, UNIT = 8, 256, 8
#: Bytes of text, about, in one range of documents that a task goes through.
RANGE_BYTES = 64 << 20


def exact_vectors(paragraphs: list[bytes]) -> np.ndarray:
    """Random 64-bit lanes of each paragraph."""
    return np.frombuffer(b"".join([hashlib.blake2b(p, digest_size=EXACT * 8).digest() for p in paragraphs]), "<u8").reshape(-1, EXACT)


def units(paragraph: bytes) -> list[bytes]:
    """A paragraph's stretches of UNIT words, so that one changed word doesn't hide a long paragraph's likeness."""
    own = paragraph.split(b" ")
    return [b" ".join(own[i : i + UNIT]) for i in range(0, len(own), UNIT)]


def sign_vectors(stretches: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join([hashlib.blake2b(u, digest_size=SIGNS // 8, person=b"signs").digest() for u in stretches]), np.uint8)
    return np.unpackbits(raw.reshape(-1, SIGNS // 8), axis=1)


class Fingerprint:
    """The fingerprint of a multiset of paragraphs."""

    def __init__(self) -> None:
        self.exact, self.signs = np.zeros(EXACT, np.uint64), np.zeros(SIGNS, np.int64)

    def add(self, paragraphs: list[bytes], times: int = 1) -> "Fingerprint":
        """Insert paragraphs (``times`` 1) or delete them (-1)."""
        if paragraphs:
            self.exact += exact_vectors(paragraphs).sum(0, dtype=np.uint64) * np.uint64(times % (1 << 64))
            own = [u for p in paragraphs for u in units(p)]
            self.signs += times * (2 * sign_vectors(own).sum(0, dtype=np.int64) - len(own))
        return self

    def hex(self) -> str:
        return (self.exact.astype("<u8").tobytes() + self.signs.astype("<i8").astype("<u4").tobytes()).hex()


def lanes(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint)[EXACT * 8 :], "<i4").astype(np.float64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated weight of shared paragraphs over that of all, 0 to 1, from two documents' sign lanes."""
    aa, bb, ab = float(a @ a), float(b @ b), float(a @ b)
    if aa == 0 and bb == 0:
        return 1.0
    whole = aa + bb - ab
    return min(1.0, max(0.0, ab / whole)) if whole > 0 else 1.0


def paragraphs(text: str) -> list[bytes]:
    return [line.encode() for line in text.split("\n") if line]


def of(text: str) -> Fingerprint:
    return Fingerprint().add(paragraphs(text))


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fingerprint string) of every whole text."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([of(t).hex() for t in batch.column("text").to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return keyed(documents).mapInArrow(tidy(run), "doc_id long, fingerprint string")


RESULT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def with_successors(documents: DataFrame) -> tuple[DataFrame, int]:
    """Documents dealt into ranges of descending doc_id, each followed by a copy (``ghost``) of the row that comes next
    in the whole order: the first row of the following range, and for the last range the first row of all; and how many
    ranges there are at most.

    The bounds are numbers, one for each partition; texts move once."""
    rows = keyed(documents)
    spark = rows.sparkSession
    n = max(2 * partitions(spark), -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES))
    bounds = -np.unique(np.array(rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n), np.int64))[::-1]

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, -ids.to_numpy(), "right").astype(np.int32))

    ranged = rows.withColumn("range", range_of("doc_id")).withColumn("ghost", F.lit(False))
    heads = ranged.groupBy("range").agg(F.max("doc_id").alias("head")).orderBy("range").collect()  # one row for each range
    if not heads:
        return ranged, 1
    to = spark.createDataFrame([(h["head"], heads[i - 1]["range"]) for i, h in enumerate(heads)], "doc_id long, to int")
    # Rows that share a head's id: the least text comes first, and only that one is copied.
    tied = Window.partitionBy("doc_id").orderBy("text")
    copies = rows.join(F.broadcast(to), "doc_id").withColumn("nth", F.row_number().over(tied)).where("nth = 1")
    return ranged.unionByName(copies.select("doc_id", "text", F.col("to").alias("range"), F.lit(True).alias("ghost"))), n


def edited(documents: DataFrame) -> DataFrame:
    """Each document against its successor in descending doc_id and against its edited text: the columns of RESULT.

    The edited fingerprint is made incrementally: paragraphs of the replaced half are deleted from the document's own
    fingerprint and the new ones inserted."""
    dealt, n = with_successors(documents)
    ordered = dealt.repartition(n, "range").sortWithinPartitions("range", "ghost", F.desc("doc_id"), "text")

    def run(batches):
        was = None  # (range, doc_id, text, fingerprint, lanes)
        for batch in batches:
            rows = []
            for key, text, where, ghost in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "range", "ghost"))):
                own = of(text)
                own_hex = own.hex()
                own_lanes = lanes(own_hex)
                if was is not None and was[0] == where:
                    rows.append(compare(*was[1:], text, own_lanes))
                was = None if ghost else (where, key, text, own, own_hex, own_lanes)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), RESULT)], [k for k, _ in RESULT])

    return ordered.mapInArrow(tidy(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def compare(key: int, text: str, own: Fingerprint, own_hex: str, own_lanes: np.ndarray, following: str, next_lanes: np.ndarray) -> tuple:
    half = len(text) // 2
    cut = len(text) - half
    new = text[:cut] + following[:half]
    border = text.rfind("\n", 0, cut) + 1  # paragraphs before it stay as they are
    changed = Fingerprint()
    changed.exact, changed.signs = own.exact.copy(), own.signs.copy()
    changed.add(paragraphs(text[border:]), -1).add(paragraphs(new[border:]))
    changed_hex = changed.hex()
    return key, len(text), hashlib.sha256(new.encode()).hexdigest(), own_hex, changed_hex, likeness(own_lanes, lanes(changed_hex)), likeness(own_lanes, next_lanes)
