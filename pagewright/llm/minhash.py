"""Operator 6: near-duplicate documents by b-bit MinHash.

A document's set holds its distinct word shingles.  Documents with equal sets form a class, and one
row stands for it.  ``BANDS`` bands of ``ROWS_IN_BAND`` minima bring candidates together; two low
bits of every minimum are packed into bit planes, and the collision-corrected similarity that bit
counts give decides which candidates are worth an exact check on full sets.

Links within a bucket are found without all its pairs: each member is first compared with the
bucket's least member and with its neighbour in the order of the next band.  Where a bucket still
holds several components, members outside its largest one ask the whole bucket, in blocks of bounded
size, whom their signatures allow as partners; what that connects is a neighbourhood, and there every
exact link between two components is kept, again in blocks.  So every link that shares a bucket joins
its components: a pair at the threshold is missed with a chance under 1e-7.
Components come from alternating large and small stars on staged edge tables.

Null and word-less texts have empty sets and no links; texts shorter than a shingle are one shingle;
where rows repeat a doc_id the least text stands for it; rows with a null doc_id are left out; an
empty table gives an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import flat, one_per_id, only, slices, stage, tidy, unstage
from .hashing import grams, mix, spans, words

BANDS, ROWS_IN_BAND, PLANES = 32, 4, 2
HASHES = BANDS * ROWS_IN_BAND
#: Rows, and about how many shingles, of a bucket or neighbourhood in one block of the pairwise steps.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: How far below the threshold an estimate may lie: about five standard deviations of HASHES comparisons at the threshold.
SLACK = 0.2
_RANDOM = np.random.default_rng(6)
_XOR = _RANDOM.integers(0, 2**63, HASHES, dtype=np.uint64)
_ODD = _RANDOM.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document; A-Z are lower-cased."""
    _, _, h, first = words(data, offsets, lower=True)
    every, out = grams(h, size), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        own = every[a : b - size + 1] if b - a >= size else spans(h, np.array([a]), np.array([b])) if b > a else every[:0]
        out.append(np.unique(own))
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minima of each non-empty set."""
    flat_sets = np.concatenate(sets)
    size = np.array([len(s) for s in sets])
    begin = np.cumsum(size) - size
    return np.stack([np.minimum.reduceat((flat_sets ^ x) * a, begin) for x, a in zip(_XOR, _ODD)], 1)


def pack(low: np.ndarray) -> np.ndarray:
    """Two low bits of every (mixed) minimum as bit planes of two 64-bit words each."""
    mixed = mix(low)
    planes = [np.packbits(((mixed >> np.uint64(p)) & np.uint64(1)).astype(np.uint8), axis=1).view(np.uint64) for p in range(PLANES)]
    return np.concatenate(planes, 1)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures: the share of equal 2-bit values less what chance gives (1 in 4)."""
    half = HASHES // 64
    equal = np.bitwise_count(~(a[..., :half] ^ b[..., :half]) & ~(a[..., half:] ^ b[..., half:])).sum(-1) / HASHES
    chance = 0.5**PLANES
    return (equal - chance) / (1 - chance)


SIGNED = "doc_id long, n_shingles long, digest binary, bands array<long>, planes array<long>"


def signatures(documents: DataFrame, size: int) -> DataFrame:
    """Set size, set digest (empty sets: null), band keys and packed bit planes of every document."""

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for lo, hi in slices(offsets):
                sets = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                full = [i for i, s in enumerate(sets) if len(s)]
                digests, bands, planes = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if full:
                    low = minima([sets[i] for i in full])
                    keys = np.zeros((len(full), BANDS), np.uint64)
                    for r in range(ROWS_IN_BAND):
                        keys = mix(keys * np.uint64(31) + low[:, r::ROWS_IN_BAND])
                    keys = mix(keys ^ np.arange(1, BANDS + 1, dtype=np.uint64))
                    bits = pack(low)
                    for k, i in enumerate(full):
                        digests[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                        bands[i], planes[i] = keys[k].view(np.int64), bits[k].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:hi], pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(planes, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "digest", "bands", "planes"],
                )

    return documents.mapInArrow(tidy(run), SIGNED)


def buckets(signed: DataFrame) -> DataFrame:
    """(key, doc, next, n, least): class representatives in every bucket that holds several."""
    several = F.posexplode("bands").alias("band", "key")
    rows = signed.select("doc_id", "bands", several).select(F.col("doc_id").alias("doc"), "key", F.element_at("bands", (F.col("band") + 1) % BANDS + 1).alias("next"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc").alias("least")).where("n > 1")
    return rows.join(shared, "key")


def first_pairs(members: DataFrame) -> DataFrame:
    """(a, b), a < b: each member with its bucket's least one and with its neighbour in the order of the next band.

    A hot bucket is ordered in slices (a slice holds equal next keys together), so no task sorts it whole."""
    slice_of = F.when(F.col("n") > BLOCK, F.pmod(F.xxhash64("next"), F.ceil(F.col("n") / BLOCK))).otherwise(F.lit(0))
    order = Window.partitionBy("key", "slice").orderBy("next", "doc")
    near = members.withColumn("slice", slice_of).withColumn("before", F.lag("doc").over(order))
    pair = F.explode(F.array("least", "before")).alias("other")
    both = near.select("doc", pair).where("other is not null and other != doc")
    return both.select(F.least("doc", "other").alias("a"), F.greatest("doc", "other").alias("b")).distinct()


def likely(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Pairs whose set sizes and packed signatures allow the threshold."""
    own = signed.select("doc_id", "n_shingles", "planes")
    left, right = (own.select(F.col("doc_id").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("planes").alias(f"p_{k}")) for k in "ab")
    both = pairs.join(left, "a").join(right, "b")
    half = HASHES // 64
    same = sum(F.bit_count(F.bitwise_not(F.col("p_a")[i].bitwiseXOR(F.col("p_b")[i])).bitwiseAND(F.bitwise_not(F.col("p_a")[half + i].bitwiseXOR(F.col("p_b")[half + i])))) for i in range(half))
    chance = 0.5**PLANES
    similar = (same / HASHES - chance) / (1 - chance) >= percent / 100 - SLACK
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return both.where(similar & sizes).select("a", "b")


def set_rows(documents: DataFrame, size: int) -> DataFrame:
    """(doc, set array<long>) of whole texts."""

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for lo, hi in slices(offsets):
                sets = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                at = np.zeros(len(sets) + 1, np.int32)
                np.cumsum([len(s) for s in sets], out=at[1:])
                values = pa.array(np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.ListArray.from_arrays(pa.array(at), values)], ["doc", "set"])

    return documents.mapInArrow(tidy(run), "doc long, set array<long>")


def exact(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets meet the threshold: 100 * intersection >= percent * union."""
    left, right = sets.select(F.col("doc").alias("a"), F.col("set").alias("s_a")), sets.select(F.col("doc").alias("b"), F.col("set").alias("s_b"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    return both.where(100 * common >= percent * (F.size("s_a") + F.size("s_b") - common)).select("a", "b")


def settled(edges: DataFrame) -> bool:
    """Whether edges (u, v), u > v, are stars: every u has one v, which is nobody's u."""
    side = lambda doc, above: F.struct(F.col(doc).alias("doc"), F.lit(above).alias("above"))
    ends = edges.select(F.inline(F.array(side("u", 1), side("v", 0))))
    return ends.groupBy("doc").agg(F.sum("above").alias("above"), F.min("above").alias("least")).where("above > 1 or above = 1 and least = 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(doc, component): the least document that each one reaches, by alternating large and small stars until all are stars.

    Each round is a staged table.  It takes few stages, and none only to see that nothing changes any more: on many partitions the
    driver keeps more about such rounds' tasks than the edges weigh."""
    pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    now = stage(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not settled(now):
        both = now.select(F.inline(F.array(pair("u", "v"), pair("v", "u"))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.inline(F.array(pair("v", "m"), pair("u", "m")))).where("u != v").distinct()
        then = stage(small, "edges")
        unstage(now)
        now = then
    return now.select(F.col("u").alias("doc"), F.col("v").alias("component"))


LINKS = "a long, b long"


def dealt_blocks(rows: DataFrame, n_rows: int, run, schema: str) -> DataFrame:
    """Apply ``run`` to groups of about BLOCK rows or of one block: blocks of small buckets are far too many for a Python
    call each, so a group holds several whole ones."""
    groups = max(1, -(-n_rows // BLOCK))
    return rows.withColumn("deal", F.pmod(F.xxhash64("key", "i", "j"), F.lit(groups))).groupBy("deal").applyInPandas(run, schema)


def each_block(group: pd.DataFrame):
    """(rows to compare with, rows that ask) of every block in a group, where it has both, as places in the group."""
    key, i, j, asks = (group[c].to_numpy() for c in ("key", "i", "j", "asks"))
    order = np.lexsort((asks, j, i, key))
    key, i, j, asks = key[order], i[order], j[order], asks[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    last = np.append(first[1:], len(order))
    asking = np.add.reduceat(asks.astype(np.int64), first)
    for a, b, n in zip(first.tolist(), last.tolist(), asking.tolist()):
        if 0 < n < b - a:
            yield order[a : b - n], order[b - n : b]


def likely_graph(rows: DataFrame, n_rows: int, percent: int) -> DataFrame:
    """(a, b): every document of a block that has a partner of another component which set sizes and signatures allow, as
    (a, a), and enough of those pairs to connect all of them: in a block no more than it has components."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        planes, size, label, docs = np.stack(group["planes"].tolist()).view(np.uint64), group["size"].to_numpy(), group["component"].to_numpy(), group["doc"].to_numpy()
        edges = []
        for left, right in each_block(group):
            above: dict[int, int] = {}  # components that edges of this block have joined
            keep = np.zeros(len(group), bool)

            def top(x: int) -> int:
                while x in above:
                    x = above[x]
                return x

            for ask in right:
                some = left[label[left] != label[ask]]
                some = some[100 * np.minimum(size[some], size[ask]) >= percent * np.maximum(size[some], size[ask])]
                some = some[estimate(planes[some], planes[ask]) >= percent / 100 - SLACK]
                if len(some):
                    keep[some] = keep[ask] = True
                    found, first = np.unique(label[some], return_index=True)
                    for other, i in zip(found.tolist(), some[first].tolist()):
                        x, y = top(int(label[ask])), top(other)
                        if x != y:
                            above[x] = y
                            edges.append((docs[ask], docs[i]))
            edges += [(d, d) for d in docs[keep]]
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return dealt_blocks(rows, n_rows, run, LINKS)


def block_links(rows: DataFrame, n_rows: int, percent: int) -> DataFrame:
    """Exact links between components within blocks: rows that ask against the others."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sets, docs, component = group["set"].tolist(), group["doc"].to_numpy(), group["component"].to_numpy()
        planes, size = np.stack(group["planes"].tolist()).view(np.uint64), np.array([len(s) for s in sets])
        out = []
        for left, right in each_block(group):
            label = component[left]
            for ask in right:
                own, n, mine = sets[ask], size[ask], component[ask]
                fit = (label != mine) & (100 * np.minimum(size[left], n) >= percent * np.maximum(size[left], n))
                fit[fit] = estimate(planes[left[fit]], planes[ask]) >= percent / 100 - SLACK
                at = np.flatnonzero(fit)
                while len(at):
                    some, at = at[:64], at[64:]
                    them = left[some]
                    joined = np.concatenate([sets[i] for i in them])
                    place = np.minimum(np.searchsorted(own, joined), n - 1)
                    begin = np.cumsum(size[them]) - size[them]
                    common = np.add.reduceat((own[place] == joined).astype(np.int64), begin)
                    for i in some[100 * common >= percent * (size[them] + n - common)]:
                        if label[i] != mine:
                            out.append((docs[ask], docs[left[i]]))
                            label[label == label[i]] = mine
                    at = at[label[at] != mine]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return dealt_blocks(rows, n_rows, run, LINKS)


def in_blocks(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows (key, doc, component, size, planes) of every key with several components, dealt into blocks (i, j) of it with
    ``asks``, and about how many those are: members outside the key's largest component are compared with all of it."""
    per = rows.groupBy("key", "component").agg(F.count("*").alias("own"), F.sum("size").alias("shingles"))
    most = per.groupBy("key").agg(F.max(F.struct("own", "component", "shingles")).alias("top"), F.sum("own").alias("n"), F.sum("shingles").alias("shingles"), F.count("*").alias("parts")).where("parts > 1")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    asking = F.greatest(F.ceil((F.col("n") - F.col("top.own")) / BLOCK), F.ceil((F.col("shingles") - F.col("top.shingles")) / BLOCK_SHINGLES)).cast("int")
    most = most.select("key", F.col("top.component").alias("largest"), blocks.alias("blocks"), asking.alias("asking"))
    full = stage(rows.join(most, "key"), "open")
    n_dealt = full.agg(F.sum(F.col("asking") + F.when(F.col("component") != F.col("largest"), F.col("blocks")).otherwise(0))).first()[0] or 0
    mine = F.xxhash64("doc")
    base = F.struct(F.lit(False).alias("asks"), F.pmod(mine, F.col("blocks")).cast("int").alias("own"), F.sequence(F.lit(0), F.col("asking") - 1).alias("others"))
    asked = F.struct(F.lit(True).alias("asks"), F.pmod(mine, F.col("asking")).cast("int").alias("own"), F.sequence(F.lit(0), F.col("blocks") - 1).alias("others"))
    roles = full.withColumn("role", F.explode(F.when(F.col("component") != F.col("largest"), F.array(base, asked)).otherwise(F.array(base))))
    dealt = roles.withColumn("other", F.explode("role.others")).select(
        "key", "doc", "component", "size", "planes", "role.asks",
        F.when(F.col("role.asks"), F.col("other")).otherwise(F.col("role.own")).alias("i"),
        F.when(F.col("role.asks"), F.col("role.own")).otherwise(F.col("other")).alias("j"),
    )
    return dealt, n_dealt


def rest(members: DataFrame, labels: DataFrame, signed: DataFrame, sets_of, percent: int) -> DataFrame:
    """Links that the first comparisons left open, between the components of a bucket.

    Signatures alone tell which documents may still link; documents that may link, directly or through others, form a
    neighbourhood.  A pair meets in one neighbourhood however many buckets it shares, so sets move once for each block of it."""
    own = labels.withColumn("component", F.coalesce("component", "doc"))
    features = signed.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("size"), "planes")

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(own, "doc", "left").withColumn("component", F.coalesce("component", "doc"))

    several = labelled(members.select("key", "doc")).groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a != b").select("key")
    near = stage(likely_graph(*in_blocks(labelled(members.select("key", "doc").join(several, "key")).join(features, "doc")), percent), "near")
    ids = stage(near.where("a = b").select(F.col("a").alias("doc")).distinct(), "near-ids")
    if ids.isEmpty():
        return near
    graph = near.where("a != b").unionByName(own.select(F.col("doc").alias("a"), F.col("component").alias("b")))
    where = components(graph).select("doc", F.col("component").alias("key"))
    dealt, n_dealt = in_blocks(labelled(ids.join(where, "doc")).join(features, "doc"))
    return block_links(dealt.join(sets_of(ids), "doc"), n_dealt, percent)


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    docs = one_per_id(documents)
    signed = stage(signatures(docs, size), "signatures")
    classes = signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = signed.join(classes.select("rep"), signed["doc_id"] == F.col("rep"), "left_semi")
    members = stage(buckets(reps), "buckets")
    pairs = stage(likely(first_pairs(members), signed, percent), "pairs")

    def sets_of(ids: DataFrame) -> DataFrame:
        return set_rows(only(docs, ids.withColumnRenamed("doc", "doc_id")), size)

    ids = stage(pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct(), "ids")
    links = stage(exact(pairs, sets_of(ids), percent), "links")
    labels = stage(components(links), "components")
    more = stage(rest(members, labels, signed, sets_of, percent), "links")
    if not more.isEmpty():
        labels = components(labels.select(F.col("doc").alias("a"), F.col("component").alias("b")).unionByName(more))
    of_rep = labels.withColumnRenamed("doc", "rep")
    out = signed.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left").join(of_rep, "rep", "left")
    # The least document of a component is the least of a class in it, which stands for the class.
    component = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
