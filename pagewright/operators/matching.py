"""Joins between boxes, words and texts: overlaps, containment, best matches and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import iou


#: Pixels of a band for boxes of ordinary height; taller ones have bands of twice, four times ... that.
BAND = 64


def _level(size: int) -> Column:
    """The least level whose bands are as tall as the box."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("y1") - F.col("y0"), F.lit(1)) / size))).cast("int")


def meeting(a: DataFrame, b: DataFrame, size: int = BAND) -> DataFrame:
    """Pairs of boxes (file, y0, y1, ...) of a file whose bands of y meet, with columns ``a_...`` and ``b_...``; every pair that
    overlaps is among them, and each comes once.

    A pair meets in the bands of its taller box's level, so a tall box is paired with what it reaches and makes no other
    pairs.  A box lies in two bands at most of each level from its own to the highest that there is."""
    top = F.greatest(*[side.agg(F.max(_level(size))).scalar() for side in (a, b)])

    def banded(side: DataFrame, name: str) -> DataFrame:
        rows = side.withColumn("own", _level(size)).withColumn("level", F.explode(F.sequence(F.col("own"), top)))
        step = size * F.pow(F.lit(2.0), F.col("level"))
        rows = rows.withColumn("from", F.floor(F.col("y0") / step)).withColumn("band", F.explode(F.sequence(F.col("from"), F.floor(F.col("y1") / step))))
        return rows.select("file", "level", "band", *[F.col(c).alias(f"{name}_{c}") for c in rows.columns if c not in ("file", "level", "band")])

    met = banded(a, "a").join(banded(b, "b"), ["file", "level", "band"])
    return met.where("(a_own = level or b_own = level) and band = greatest(a_from, b_from)").drop("level", "band", "a_own", "b_own", "a_from", "b_from")


def overlapping(a: DataFrame, b: DataFrame, least: float = 0.2, band: int = BAND) -> DataFrame:
    """(file, a_id, b_id, iou) of boxes (file, id, x0, y0, x1, y1) that overlap enough; boxes meet in bands of y."""
    share = iou(*({c: F.col(f"{k}_{c}") for c in ("x0", "y0", "x1", "y1")} for k in "ab"))
    return meeting(a, b, band).where("a_x0 < b_x1 and b_x0 < a_x1").withColumn("iou", share).where(F.col("iou") >= least).select("file", "a_id", "b_id", "iou")


def one_to_one(pairs: DataFrame) -> DataFrame:
    """Pairs whose both sides are in no other pair."""
    alone = lambda c: F.count("*").over(Window.partitionBy("file", c)) == 1
    return pairs.withColumn("alone", alone("a_id") & alone("b_id")).where("alone").drop("alone")


def held_words(words: DataFrame, lines: DataFrame, band: int = BAND) -> DataFrame:
    """(file, line, text): words whose centre lies in a line's box, in order of x."""
    y = F.col("y0") + (F.col("y1") - F.col("y0")) / 2
    middle = words.select("file", "id", "text", "x0", (F.col("x0") + (F.col("x1") - F.col("x0")) / 2).alias("cx"), y.alias("y0"), y.alias("y1"))
    inside = meeting(middle, lines.select("file", "id", "x0", "y0", "x1", "y1"), band).where("a_cx >= b_x0 and a_cx < b_x1 and a_y0 >= b_y0 and a_y0 < b_y1")
    own = F.array_sort(F.collect_list(F.struct("a_x0", "a_id", "a_text")))
    return inside.groupBy("file", F.col("b_id").alias("line")).agg(F.array_join(F.transform(own, lambda w: w["a_text"]), " ").alias("text"))


def best_by_jaccard(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """For each target (group, id, tokens) the source of its group that shares most tokens, the first of equals; only those that
    share any.  Candidates meet on tokens, so groups aren't paired whole."""
    t = targets.select("group", F.col("id").alias("target"), F.array_distinct("tokens").alias("t"))
    s = sources.select("group", F.col("id").alias("source"), F.array_distinct("tokens").alias("s"))
    met = t.select("group", "target", F.explode("t").alias("w")).join(s.select("group", "source", F.explode("s").alias("w")), ["group", "w"]).groupBy("group", "target", "source").agg(F.count("*").alias("common"))
    sized = met.join(t.select("group", "target", F.size("t").alias("nt")), ["group", "target"]).join(s.select("group", "source", F.size("s").alias("ns")), ["group", "source"])
    scored = sized.withColumn("score", F.col("common") / (F.col("nt") + F.col("ns") - F.col("common")))
    return scored.groupBy("group", "target").agg(F.max(F.struct("score", (-F.col("source")).alias("neg"))).alias("b")).select("group", "target", (-F.col("b.neg")).alias("source"), "b.score")


def inversions(frame: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, inversions): pairs of whole numbers from 0 on that stand in the wrong order.

    Two numbers differ first at some bit: the pair is wrong there if the one with the bit set stands before.  So for each bit,
    running counts among the numbers that agree in all higher bits give all pairs, and none is made or gathered."""
    top = F.max(value).over(Window.partitionBy(group))
    rows = frame.select(group, F.col(order).alias("_at"), F.col(value).cast("bigint").alias("_v"), top.alias("_top"))
    bits = rows.select(group, "_at", "_v", F.explode(F.sequence(F.lit(0), F.length(F.bin("_top")) - 1)).alias("_bit"))
    marked = bits.select(group, "_at", "_bit", F.expr("_v div cast(pow(2, _bit + 1) as bigint)").alias("_above"), F.getbit("_v", F.col("_bit")).cast("bigint").alias("_set"))
    before = Window.partitionBy(group, "_bit", "_above").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    wrong = F.when(F.col("_set") == 0, F.coalesce(F.sum("_set").over(before), F.lit(0))).otherwise(0)
    return marked.select(group, wrong.alias("_wrong")).groupBy(group).agg(F.sum("_wrong").alias("inversions"))


def raster_order(frame: DataFrame, group: str, row: int = 45, tie: str = "ord") -> DataFrame:
    """Adds ``rank``: rows of the page from the top, from left to right in each; equal places by ``tie``."""
    return frame.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.floor(F.col("vpos") / row), "hpos", tie)))
