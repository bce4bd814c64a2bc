"""Operator 12: the prefix trie of conversations, by smallest-member ownership.

A node is a distinct sequence of a conversation's first turns (role, text); conversations that start with it are its
members.  Each node belongs to its smallest member.  Along a conversation's path the smallest member only rises, so what
a conversation owns is a suffix of its path; a window over the path marks it.  Sums over a subtree are then sums over the
node's members: what each of them holds from there on, less what it owns there, and one leaf for each member that owns a
leaf.  So one group-by of (member, prefix) rows gives all figures of all nodes, with nothing walked from level to level.

A prefix is named by its depth and four running sums of 32 bits each over hashes of (place, turn), hashed again; no path
is gathered in a row.  The ids that end at a node are joined in stretches of 4096 numbers and hashed stretch by stretch,
so a node where a third of all conversations end needs no more memory than another.

Rows with a null conv_id are left out; a null role or text is empty; turns are ordered by turn, null first, and turns
with the same number by the MD5 of role and text.  Repeated rows are turns of their own.  A conversation without rebuilt
turns ends at the root.  An empty table has no nodes.  Other columns aren't looked at.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import partitions, small_batches, stage, tidy, with_hot_keys

#: Turns that a conversation takes from the first one of its hundred: crc32 modulo this.
HEADS, GROUP = 6, 100
#: Ids of one stretch of numbers (a power of two) that are joined before they are hashed.
STRETCH_BITS = 12


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 1, turn digest, chars) of every turn."""
    small_batches(conversations.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"), F.length(text).cast("long").alias("chars")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.select("conv_id", F.row_number().over(order).alias("place"), "digest", "chars")


def rebuilt(turns: DataFrame) -> DataFrame:
    """The same rows after each conversation's first turns have been taken from the first one of its hundred, and a row
    of place 0 for each conversation, without a digest."""
    head = F.crc32(F.col("conv_id").cast("string")) % HEADS
    own = turns.where(F.col("place") > head)
    ids = turns.select("conv_id").distinct()
    first = turns.where(F.col("place") < HEADS).where(F.col("conv_id") % GROUP == 0).withColumnRenamed("conv_id", "base")
    wanted = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), head.alias("head"))
    taken = wanted.join(first, "base").where("place <= head").select("conv_id", "place", "digest", "chars")  # at most 5 rows a base
    roots = ids.select("conv_id", F.lit(0).alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"))
    return own.unionByName(taken).unionByName(roots)


def _named(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums])))


def prefix_rows(paths: DataFrame) -> DataFrame:
    """(conv_id, depth, node, up, ends, tail): one row for each prefix of each conversation, with the node above it, whether
    the conversation ends there, and the characters it holds from there on."""
    along = Window.partitionBy("conv_id").orderBy("place")
    back = Window.partitionBy("conv_id").orderBy(F.desc("place"))
    deep = paths.withColumn("depth", F.row_number().over(along) - 1)
    mixed = deep.withColumn("mixed", F.md5(F.concat_ws(":", F.col("depth").cast("string"), F.hex("digest"))))
    part = lambda k: F.when(F.col("depth") > 0, F.conv(F.substring("mixed", 8 * k + 1, 8), 16, 10).cast("long")).otherwise(0)
    named = mixed.select("conv_id", "place", "depth", "chars", _named(F.col("depth"), [F.sum(part(k)).over(along) for k in range(4)]).alias("node"))
    return named.select(
        "conv_id", "depth", "node", F.lag("node").over(along).alias("up"), F.lead("place").over(along).isNull().alias("ends"), F.sum("chars").over(back).alias("tail")
    )


def ends_digests(rows: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes where conversations end: the SHA-256 of their ids in order, joined by commas."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    stretches = rows.where("ends").groupBy("node", F.shiftright("conv_id", STRETCH_BITS).alias("stretch")).agg(ids.alias("ids"))  # bounded by the stretch

    def run(batches):
        node, state = None, None
        for batch in batches:
            done = []
            for name, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if name != node:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = name, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    ordered = stretches.repartition(partitions(rows.sparkSession), "node").sortWithinPartitions("node", "stretch")
    return ordered.mapInArrow(tidy(run), "node binary, ends_sha256 string")


def trie(paths: DataFrame) -> DataFrame:
    """One row for each node of the paths' trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256."""
    rows = stage(prefix_rows(paths), "prefixes")
    owners = rows.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.bool_and("ends").alias("leaf"))
    owned = owners.groupBy("conv_id").agg(F.min("depth").alias("owned_from"), F.max("leaf").alias("leaf"))  # a leaf can only be the path's end
    back = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    marked = rows.join(owned, "conv_id", "left").withColumn("own", F.coalesce(F.col("depth") >= F.col("owned_from"), F.lit(False)))
    held = marked.withColumn("own_tail", F.coalesce(F.max(F.when(F.col("own"), F.col("tail"))).over(back), F.lit(0)))
    count = lambda flag: F.sum(F.coalesce(flag, F.lit(False)).cast("long"))
    nodes = held.groupBy("node").agg(
        F.min(F.struct("conv_id", (F.col("depth") == F.col("owned_from")).alias("first"), "up")).alias("top"), F.max("depth").alias("depth"), F.count("*").alias("n_convs"),
        count(~F.col("ends") & (F.col("depth") + 1 >= F.col("owned_from"))).alias("n_children"), count(F.col("leaf")).alias("n_leaves"), F.sum(F.col("tail") - F.col("own_tail")).alias("saved_tokens"),
    ).select("node", "top.conv_id", "top.first", "top.up", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")
    nodes = stage(nodes, "nodes")
    # The node above belongs to the same conversation, but for the first one that a conversation owns.
    above = nodes.where("n_children > 0").select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    hot = nodes.where(F.col("n_children") > common.HOT).select(F.col("node").alias("up"))
    entered = with_hot_keys(nodes.where("first and depth > 0"), above, "up", hot)
    inside = nodes.where("not first or depth = 0").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    whole = entered.unionByName(inside).join(ends_digests(rows), "node", "left")
    longs = [F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    return whole.select(*longs, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
