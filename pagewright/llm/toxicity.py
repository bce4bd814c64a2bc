"""Operator 10: toxicity by non-negative positive-unlabelled learning.

Training takes confirmed toxic documents (positives) and unlabelled text.  Lower-cased words are
hashed; words that mark positives are chosen by the likelihood ratio of document frequencies, and a
logistic model on their presence is fitted in numpy by gradient descent on the non-negative risk

    prior * E_P[loss(+1)] + max(0, E_U[loss(-1)] - prior * E_P[loss(-1)])

where ``prior`` is the class prior: the share of positives among labels, but no more than marked words
allow (their share in unlabelled text over their share in positives).  The fit sees at most ``positives`` and ``unlabelled`` documents,
taken by a hash of their ids: both bounds are parameters, 6000 and 12000 by default, and at most ``MOST_WORDS`` words count.  Scoring reads
every whole text.  Labels, language, source and doc_id never enter a score.

A null or empty text has no marked word and gets the model's base score, ``NO_EVIDENCE`` at most, and under half of one in the
number of unlabelled documents if no word marks positives; a null label is no label;
rows with a null doc_id are left out; repeated rows are scored alike; without any positive the
prior is 0 and every score is 0.  Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod4, flat, give_back, keyed, slices, tidy
from .hashing import text_words

MIN_DOCS, MIN_GAIN, MIN_POSTERIOR, MOST_WORDS, CAUTION = 4, 20.0, 0.4, 4096, 0.8
#: A document without any marked word scores at most this: the share of positives among labels says nothing about it.
NO_EVIDENCE = 0.2


@dataclass(frozen=True)
class Model:
    keys: np.ndarray  # sorted hashes of the words that count
    weights: np.ndarray  # none below zero
    slope: float
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability of each document; ``data`` and ``offsets`` as :func:`flat` gives them."""
        total = np.zeros(len(offsets) - 1)
        for lo, hi in slices(offsets):
            part = data[offsets[lo] : offsets[hi]]
            h, first = text_words(part, offsets[lo : hi + 1] - offsets[lo])
            if not len(self.keys) or not len(h):
                continue
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == h)
            doc = np.searchsorted(first, hit, "right") - 1
            pair = np.unique(doc * len(self.keys) + at[hit])
            np.add.at(total, lo + pair // len(self.keys), self.weights[pair % len(self.keys)])
        logit = self.slope * saturated(total) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60))) if np.isfinite(self.bias) else total


def thinned(docs: list[np.ndarray]) -> list[np.ndarray]:
    """Without near copies of earlier documents, whose rare words would look frequent: any of four keys of three minima agrees."""
    odd = np.random.default_rng(5).integers(1, 2**63, 12, dtype=np.uint64) | np.uint64(1)
    seen, out = set(), []
    for h in docs:
        low = [(h * a).min() for a in odd] if len(h) else []
        keys = [(i, *map(int, low[i : i + 3])) for i in range(0, len(low), 3)]
        if not any(k in seen for k in keys):
            out.append(h)
        seen.update(keys)
    return out


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 1000, decay: float = 1e-3) -> Model:
    """``positive`` and ``unlabelled``: the distinct word hashes of each document."""
    if not positive or not unlabelled or prior <= 0:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, -np.inf)
    distinct_p, distinct_u = thinned(positive), thinned(unlabelled)  # words are counted without near copies
    n_p, n_u = len(distinct_p), len(distinct_u)
    keys, counts = np.unique(np.concatenate(distinct_p), return_counts=True)
    some = counts >= min(MIN_DOCS, max(1, n_p // 2))
    keys, counts = keys[some], counts[some]
    them = np.concatenate(distinct_u)
    at = np.minimum(np.searchsorted(keys, them), max(len(keys) - 1, 0))
    base = np.bincount(at[keys[at] == them] if len(keys) else at[:0], minlength=len(keys))
    p, q = counts / n_p, base / n_u
    # Words whose class-prior-corrected posterior is high, and surely above the unlabelled rate (likelihood ratio).
    mean = np.maximum(q, 0.5 / n_u)
    gain = 2 * n_p * (p * np.log(p / mean) - (p - mean))
    marks = (prior * p / mean >= MIN_POSTERIOR) & (p > mean)
    gain = np.where(marks, gain, 0)
    best = np.argsort(-gain, kind="stable")[:MOST_WORDS]
    keys = np.sort(keys[best[gain[best] >= MIN_GAIN]])

    def design(docs: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(docs), len(keys)), np.float32)
        for row, h in zip(out, docs):
            at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            row[at[keys[at] == h]] = 1
        return out

    if not len(keys):
        # No word tells positives from unlabelled text, so nothing speaks for any document, whatever was labelled.
        return Model(keys, np.zeros(0), 0.0, float(-np.log(2 * n_u + 1)))
    x_p, x_u = design(positive), design(unlabelled)
    # Labels may be chosen by their class, so their share is no more than a guess: the share of unlabelled documents with
    # a marked word, over that share of positives, is an upper bound of the prior.
    prior = min(prior, max(x_u.any(1).mean(), 0.5 / len(x_u)) / max(x_p.any(1).mean(), 0.5 / len(x_p)))
    prior *= CAUTION  # an overestimated prior would lift documents without any marked word
    w, _ = descend(x_p, x_u, prior, steps, decay)
    # The ridge finds the direction.  Evidence saturates where nearly all positives with any of it stand; how much it
    # moves a score, and the bias, are then fitted alone, without a penalty.
    seen = (x_p @ w)[x_p.any(1)]
    full = max(float(np.quantile(seen, 0.05)) if len(seen) else 1.0, 1e-9)
    a, b = descend(saturated(x_p @ w / full)[:, None], saturated(x_u @ w / full)[:, None], prior, steps, 1e-6)
    return Model(keys, w / full, float(a[0]), min(b, float(np.log(NO_EVIDENCE / (1 - NO_EVIDENCE)))))


def saturated(evidence: np.ndarray) -> np.ndarray:
    """Linear up to 1; beyond, more evidence still ranks higher but hardly adds."""
    return np.minimum(evidence, 1) + 0.02 * np.log1p(np.maximum(evidence - 1, 0))


def descend(x_p: np.ndarray, x_u: np.ndarray, prior: float, steps: int, decay: float) -> tuple[np.ndarray, float]:
    """Weights (none below zero) and bias of the least non-negative risk, by Adam on the whole sample."""
    n_p, n_u = len(x_p), len(x_u)
    w, b = np.zeros(x_p.shape[1]), float(np.log(prior / (1 - min(prior, 0.999))))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        s_p, s_u = 1 / (1 + np.exp(-(x_p @ w + b))), 1 / (1 + np.exp(-(x_u @ w + b)))
        risk = float(np.mean(-np.log(1 - s_u + 1e-12)) - prior * np.mean(-np.log(1 - s_p + 1e-12)))
        up = 1.0 if risk >= 0 else 0.0
        sign = 1.0 if risk >= 0 else -1.0  # below zero the step undoes the overfitted negative part
        g_p, g_u = up * prior * (s_p - 1) / n_p - sign * prior * s_p / n_p, sign * s_u / n_u
        grad = np.append(x_p.T @ g_p + x_u.T @ g_u + decay * w, g_p.sum() + g_u.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = 0.1 / (1 + t / 300) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        w, b = np.maximum(w - step[:-1], 0), b - step[-1]  # a marked word never speaks against toxicity
    return w, float(b)


def train(documents: DataFrame, labels: DataFrame, positives: int = 6000, unlabelled: int = 12000) -> Model:
    """Fit on the given labels (callers leave held-out rows away) and on unlabelled documents that aren't held out.

    The samples are bounded, so ids and word hashes of at most ``positives + unlabelled`` documents reach the driver."""
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    n = known.agg(F.count("*").alias("n"), F.sum((F.col("toxic") == 1).cast("int")).alias("p")).first()
    prior = (n["p"] or 0) / n["n"] if n["n"] else 0.0
    by_hash = F.xxhash64("doc_id")
    p_ids = known.where("toxic = 1").select("doc_id").distinct().orderBy(by_hash).limit(positives).withColumn("kind", F.lit(1))
    other = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).where(crc_mod4(F.col("doc_id")) != 2)
    u_ids = other.orderBy(by_hash).limit(unlabelled).withColumn("kind", F.lit(0))
    ids = p_ids.unionByName(u_ids)

    def features(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            got = []
            for lo, hi in slices(offsets):
                h, first = text_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                got += [np.unique(h[a:b]).tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(got, pa.binary())], ["kind", "words"])

    # Bounded by the two parameters, so broadcasting the ids and collecting the features is too.
    rows = keyed(documents).join(F.broadcast(ids), "doc_id").mapInArrow(tidy(features), "kind int, words binary").toArrow()
    words = [np.frombuffer(w.as_buffer(), np.uint64) for w in rows.column("words")]
    kinds = rows.column("kind").to_pylist()
    model = fit([w for w, k in zip(words, kinds) if k == 1], [w for w, k in zip(words, kinds) if k == 0], prior)
    del rows, words
    give_back()  # the driver lives on, for other operators too
    return model


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score double) of every whole text."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(*flat(batch.column("text"))), pa.float64())], ["doc_id", "score"])

    return keyed(documents).mapInArrow(tidy(run), "doc_id long, score double")


def score_column(model: Model, text: Column) -> Column:
    """The score of a text column; null counts as empty."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(*flat(pa.array(texts, pa.large_string()))))

    return scored(F.coalesce(text, F.lit("")))


def held_out(doc_id: Column) -> Column:
    """Whether a document's label must not be learned from."""
    return crc_mod4(doc_id) == 2


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = train(documents, labels.where(~held_out(F.col("doc_id"))))
    return score(documents, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
