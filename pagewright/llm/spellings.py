"""Operator 11: grouping of spelling variants by full neighbourhood generation.

Words are near if one is the other with one code point inserted, deleted or replaced.  Every distinct deletion, replacement
and insertion over the observed alphabet is made for every word and looked up in the vocabulary by its hash; what is found
is near, and no distance is computed.

Candidates are some thousand times the words, so they are never shuffled.  An edit leaves one half of a word as it is: a
word of length L is dealt out under its first and its last half (for partners of its own length or one less) and under the
halves that a partner of length L + 1 would share with it, and each candidate is made and met where its unchanged half
lies: four rows a word, and each edit is made in exactly one of them.  Deleting one of equal neighbours, or inserting beside an
equal one, gives the same word; only the first place counts.  Candidate hashes are sums of random numbers for (place, code
point), so each costs two additions; words with equal hashes are compared byte by byte.

A half that more than ``GROUP_MOST`` words share isn't kept together: its words' candidates are spelt out and dealt out by
their own text, and meet the vocabulary in an ordinary join.

Words are Latin-1 by the pattern of runs, so one byte is one code point.  A null text has no runs; a null doc_id is the empty
string before the colon; repeated rows count as often as they come.  Empty tables give no rows.  Other columns aren't looked
at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, only, partitions, small_batches, stage, tidy, unstage
from .hashing import mix

RUN, DELETE_EVERY, LEAST_CHARS, LEAST_N, RATIO = r"[A-Za-zÀ-ÿ]+", 199, 6, 5, 5
#: Words of one half that one task holds; halves with more go by their candidates.
GROUP_MOST = 200_000
#: Candidates that a task makes at once.
BLOCK = 1 << 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(documents: DataFrame, every: int = DELETE_EVERY) -> DataFrame:
    """(doc_id, word): the runs of all texts, A-Z lower-cased; those whose hash ``every`` divides with one code point less."""
    small_batches(documents.sparkSession)
    runs = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    low = runs.select("doc_id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _UPPER.lower())).otherwise(F.col("run")).alias("run"))
    hashed = low.withColumn("h", F.crc32(F.concat("doc_id", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return hashed.select("doc_id", F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_chars: int = LEAST_CHARS, least_n: int = LEAST_N) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    return words.where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def halves(vocabulary: DataFrame) -> DataFrame:
    """(key, longer, first, raw, n): each word under the halves that an edit would leave as they are, in Latin-1.

    With ``longer`` the partner has one code point more; with ``first`` the first half is shared, up to half of the longer
    one's length."""
    size = F.length("word")

    def row(longer: bool, first: bool):
        full = size + int(longer)
        half = F.floor(full / 2).cast("int")
        part = F.substr("word", F.lit(1), half) if first else F.substr("word", half + (0 if longer else 1))
        return F.struct(F.xxhash64(full, F.lit(first), part).alias("key"), F.lit(longer).alias("longer"), F.lit(first).alias("first"))

    each = F.explode(F.array(*[row(longer, first) for longer in (False, True) for first in (True, False)])).alias("row")
    return vocabulary.select(each, F.encode("word", "ISO-8859-1").alias("raw"), "n").select("row.*", "raw", "n")


def _valued(place: np.ndarray, code: np.ndarray) -> np.ndarray:
    """A random number for each (place, code point)."""
    return mix((place.astype(np.uint64) << np.uint64(8) | code.astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15))


def _matrix(data: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    return data[start[:, None] + np.arange(size)]


def edits(word: np.ndarray, longer: bool, first: bool, alphabet: np.ndarray):
    """For words of one length (a row of bytes each): (place, codes, hashes, valid) for each place where the other half is
    edited.  ``codes`` is None for deletions, with one hash a word; else there is one hash for each word and code, of
    replacements, or with ``longer`` of insertions."""
    size = word.shape[1]
    place = np.arange(size)
    head = np.concatenate([np.zeros((len(word), 1), np.uint64), np.cumsum(_valued(place, word), 1, dtype=np.uint64)], 1)
    half = (size + int(longer)) // 2
    if longer:
        moved = np.cumsum(_valued(place + 1, word), 1, dtype=np.uint64)
        tail = np.concatenate([moved[:, -1:], moved[:, -1:] - moved], 1)  # of what lies from each place on, one place later
        for i in range(half, size + 1) if first else range(half):
            valid = word[:, i - 1 : i] != alphabet if i else np.ones((len(word), len(alphabet)), bool)
            yield i, alphabet, (head[:, i] + tail[:, i])[:, None] + _valued(np.array(i), alphabet), valid
        return
    moved = np.cumsum(_valued(place - 1, word), 1, dtype=np.uint64)  # place -1 wraps round, and is never used
    for i in range(half, size) if first else range(half):
        valid = word[:, i] != word[:, i - 1] if i else np.ones(len(word), bool)
        yield i, None, head[:, i] + moved[:, -1] - moved[:, i], valid
        yield i, alphabet, (head[:, -1] - _valued(np.array(i), word[:, i]))[:, None] + _valued(np.array(i), alphabet), word[:, i : i + 1] != alphabet


def spelt(word: np.ndarray, longer: bool, place: int, code: np.ndarray | None) -> np.ndarray:
    """The words with that edit: one row of bytes each."""
    if code is None:
        return np.delete(word, place, 1)
    out = np.insert(word, place, 0, 1) if longer else word.copy()
    out[:, place] = code
    return out


class _Vocabulary:
    """The distinct words of a block, most frequent first (ties in code-point order), found by their hashes and compared
    byte by byte."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, n: np.ndarray):
        raw = data.tobytes()
        found = dict(zip([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], n.tolist()))
        self.words = sorted(found, key=lambda w: (-found[w], w))
        self.n = [found[w] for w in self.words]
        size = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.data = np.frombuffer(b"".join(self.words), np.uint8)
        self.start = np.cumsum(size) - size
        self.alphabet = np.unique(self.data)
        self.by_size = {}
        bits = 4 + max(1, len(self.words)).bit_length()
        self.shift, self.some = np.uint64(64 - bits), {}
        for k in np.unique(size).tolist():
            own = np.flatnonzero(size == k)
            h = np.concatenate([_valued(np.arange(k), _matrix(self.data, self.start[x], k)).sum(1, dtype=np.uint64) for x in np.array_split(own, max(1, len(own) * k // BLOCK))])
            order = np.argsort(h, kind="stable")
            self.by_size[k] = h[order], own[order]
            self.some[k] = np.zeros(1 << bits, bool)
            self.some[k][h >> self.shift] = True

    def look_up(self, hashes: np.ndarray, valid: np.ndarray, size: int):
        """(index of the candidate, index of a word with its hash), all such pairs."""
        if size not in self.by_size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero((self.some[size][hashes >> self.shift] & valid).ravel())
        keys, own = self.by_size[size]
        h = hashes.ravel()[at]
        lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
        times = hi - lo
        return np.repeat(at, times), own[np.repeat(lo - np.cumsum(times) + times, times) + np.arange(int(times.sum()))]


def _near(batches):
    """(raw, n_near, form, form_n): for each row of a block's words, the near words that its edits find."""
    for columns in _whole_keys(batches):
        data, offsets = columns["data"], columns["offsets"]
        known = _Vocabulary(data, offsets, columns["n"])
        count = np.zeros(len(offsets) - 1, np.int64)
        best = np.full(len(count), len(known.words))
        for rows, word, longer, first in _alike(columns):
            size = word.shape[1] + (1 if longer else 0)
            for place, codes, hashes, valid in edits(word, longer, first, known.alphabet):
                at, other = known.look_up(hashes, valid, size - (codes is None))
                if not len(at):
                    continue
                which, code = (at, None) if codes is None else (at // len(codes), codes[at % len(codes)])
                got = spelt(word[which], longer, place, code)
                same = (got == _matrix(known.data, known.start[other], got.shape[1])).all(1)
                np.add.at(count, rows[which[same]], 1)
                np.minimum.at(best, rows[which[same]], other[same])
        hit = np.flatnonzero(count)
        raw = data.tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array([raw[offsets[i] : offsets[i + 1]] for i in hit.tolist()], pa.binary()), pa.array(count[hit]), pa.array([known.words[k] for k in best[hit].tolist()], pa.binary()), pa.array([known.n[k] for k in best[hit].tolist()], pa.int64())],
            ["raw", "n_near", "form", "form_n"],
        )


def _alike(columns: dict):
    """(rows, their words as a matrix, longer, first) for rows of one length and kind, not too many at once."""
    data, offsets = columns["data"], columns["offsets"]
    size = np.diff(offsets)
    kind = size * 4 + columns["longer"] * 2 + columns["first"]
    order = np.argsort(kind, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1):
        if not len(own):
            continue
        k = int(size[own[0]])
        for rows in np.array_split(own, -(-len(own) * max(k, 96) // BLOCK)):
            yield rows, _matrix(data, offsets[rows], k), bool(columns["longer"][own[0]]), bool(columns["first"][own[0]])


def _columns(parts: list[pa.RecordBatch]) -> dict:
    whole = pa.Table.from_batches(parts).combine_chunks()
    out = {c: whole.column(c).to_numpy().astype(np.int64) for c in ("longer", "first", "n")}
    out["data"], out["offsets"] = flat(whole.column("raw"))
    return out


def _whole_keys(batches, most: int = 50_000):
    """Blocks of consecutive rows in which no key is split, of ``most`` rows or little more, but for longer keys."""
    kept, held = [], 0
    for batch in batches:
        keys = batch.column("key").to_numpy()
        ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)).astype(np.int64)
        if kept and len(keys) and held >= most and kept[-1].column("key")[-1].as_py() != keys[0]:
            yield _columns(kept)
            kept, held = [], 0
        lo = 0
        for end in ends[:-1].tolist():  # the last key may go on in the next batch
            if held + end - lo >= most:
                yield _columns([*kept, batch.slice(lo, end - lo)])
                kept, held, lo = [], 0, end
        if lo < len(keys):
            kept.append(batch.slice(lo))
            held += len(keys) - lo
    if kept:
        yield _columns(kept)


def _candidates(alphabet: list[int]):
    """(candidate, raw): every edit of every row, spelt out."""
    codes_of = np.array(alphabet, np.uint8)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                columns = _columns([batch.slice(lo, 4096)])
                raw, offsets = columns["data"].tobytes(), columns["offsets"]
                for rows, word, longer, first in _alike(columns):
                    names = np.array([raw[offsets[i] : offsets[i + 1]] for i in rows.tolist()], object)
                    for place, codes, _, valid in edits(word, longer, first, codes_of):
                        at = np.flatnonzero(valid.ravel())
                        which, code = (at, None) if codes is None else (at // len(codes), codes[at % len(codes)])
                        for some in np.array_split(np.arange(len(at)), -(-len(at) * word.shape[1] // BLOCK) or 1):
                            made = spelt(word[which[some]], longer, place, None if code is None else code[some])
                            flat_made, k = made.tobytes(), made.shape[1]
                            yield pa.RecordBatch.from_arrays([pa.array([flat_made[i : i + k] for i in range(0, len(flat_made), k)], pa.binary()), pa.array(names[which[some]], pa.binary())], ["candidate", "raw"])

    return run


def near(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) for the words that have near ones: how many, and the most frequent one."""
    rows = halves(vocabulary)
    spark = vocabulary.sparkSession
    common = stage(rows.groupBy("key").count().where(F.col("count") > GROUP_MOST).select("key"), "common-halves")
    own = only(rows, common, "key", "left_anti")
    found = own.repartition(partitions(spark), "key").sortWithinPartitions("key").mapInArrow(tidy(_near), "raw binary, n_near long, form binary, form_n long")
    if not common.isEmpty():
        letters = vocabulary.select(F.explode(F.split("word", "")).alias("c")).distinct().select(F.ascii("c")).collect()  # Latin-1: at most 256
        made = only(rows, common, "key").mapInArrow(tidy(_candidates(sorted(r[0] for r in letters))), "candidate binary, raw binary")
        known = vocabulary.select(F.encode("word", "ISO-8859-1").alias("candidate"), F.col("n").alias("form_n"))
        found = found.unionByName(made.join(known, "candidate").select("raw", F.lit(1).cast("long").alias("n_near"), F.col("candidate").alias("form"), "form_n"))
    best = found.groupBy("raw").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    return best.select(F.decode("raw", "ISO-8859-1").alias("word"), "n_near", F.decode("best.form", "ISO-8859-1").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form): every round follows each link twice as far, and forms only get more frequent."""
    now = stage(links.select("word", F.col("form").alias("root")), "links")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        far = stage(now.join(on, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "links")
        unstage(now)
        now = far.select("word", "root")
        now._staged_at = far._staged_at
        if far.where("moved").isEmpty():
            return now


def variants(counted: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n for each word of a vocabulary (word, n)."""
    known = stage(counted.select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    whole = known.join(near(known), "word", "left")
    holds = F.col("form_n") >= ratio * F.col("n")
    formed = stage(whole.select("word", F.when(holds, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(holds, F.col("form_n")).cast("long").alias("form_n")), "forms")
    unstage(known)
    ends = roots(formed.where("form is not null").select("word", "form"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
