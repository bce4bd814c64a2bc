"""Ink on grey images: thresholds, blank columns, ink under cuts, and ink that no box covers.

An image is rows (image, y, row) with ``row`` an array of grey values from 0 to 255, so one of any height is dealt out by rows.
Thresholds come from histograms, summed before they are shuffled; columns from their darkest pixel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Boxes grow by this share of their size before ink counts as uncovered.
GROWN = 0.10
#: The threshold of an image of one grey value, for the rule that takes darker pixels than the threshold as ink.
EVEN = 128


def thresholds(images: DataFrame) -> DataFrame:
    """(image, at, below): Otsu thresholds by two rules, the least level of the largest variance between classes.

    By ``at``, shares of pixels are compared and ink is up to the threshold (0 for an image of one value); by ``below``, counts of
    pixels, and ink is darker than it (``EVEN`` for such an image)."""
    levels = images.select("image", F.explode("row").alias("level")).groupBy("image", "level").agg(F.count("*").cast("double").alias("n"))
    upto, whole = Window.partitionBy("image").orderBy("level"), Window.partitionBy("image")  # at most 256 rows an image
    mass = F.col("level") * F.col("n")
    rows = levels.select("image", "level", F.sum("n").over(upto).alias("dark"), F.sum(mass).over(upto).alias("sum"), F.sum("n").over(whole).alias("all"), F.sum(mass).over(whole).alias("total"))
    share, mean = F.col("dark") / F.col("all"), F.col("sum") / F.col("all")
    spread = share * (1 - share)
    off = F.col("total") / F.col("all") * share - mean
    at = off * off / F.when(spread == 0, 1e-9).otherwise(spread)
    light = F.col("all") - F.col("dark")
    apart = F.col("sum") / F.col("dark") - (F.col("total") - F.col("sum")) / F.nullif(light, F.lit(0.0))
    below = F.col("dark") * light * (apart * apart)
    best = lambda c: F.max(F.struct(F.col(c).alias("v"), (-F.col("level")).alias("level")))
    scored = rows.select("image", "level", at.alias("at"), F.when(light > 0, below).alias("below"))
    found = scored.groupBy("image").agg(best("at").alias("a"), F.max(F.when(F.col("below").isNotNull(), F.struct(F.col("below").alias("v"), (-F.col("level")).alias("level")))).alias("b"))
    return found.select("image", F.when(F.col("a.v") > 0, -F.col("a.level")).otherwise(0).alias("at"), F.coalesce(-F.col("b.level"), F.lit(EVEN)).alias("below"))


def columns(images: DataFrame) -> DataFrame:
    """(image, x, darkest) of every column."""
    return images.select("image", F.posexplode("row").alias("x", "grey")).groupBy("image", "x").agg(F.min("grey").alias("darkest"))


def blank_runs(columns: DataFrame, levels: DataFrame, heights: DataFrame, strict: bool = False) -> DataFrame:
    """(image, start, end) of the runs of columns without ink that are wide enough for a blank between words: an eighth of the
    image's height, two columns at least.  With ``strict``, ink is darker than ``below``, else up to ``at``."""
    blank = F.col("darkest") >= F.col("below") if strict else F.col("darkest") > F.col("at")
    rows = columns.join(levels, "image").where(blank)
    run = F.col("x") - F.row_number().over(Window.partitionBy("image").orderBy("x"))
    runs = rows.withColumn("run", run).groupBy("image", "run").agg(F.min("x").alias("start"), (F.max("x") + 1).alias("end"))
    wide = F.greatest(F.lit(2), F.floor(F.col("height") / 8))
    return runs.join(heights, "image").where(F.col("end") - F.col("start") >= wide).select("image", "start", "end")


def cut_states(cuts: DataFrame, columns: DataFrame, levels: DataFrame, least: int = 15) -> DataFrame:
    """Cuts (image, k, a, b) of two resolvers that lie ``least`` or more apart, with ``a_state`` and ``b_state``: ``blank``, ``inked``, or
    ``outside`` the image."""
    apart = cuts.where(F.abs(F.col("a") - F.col("b")) >= least)
    ink = columns.join(levels, "image").select("image", "x", (F.col("darkest") <= F.col("at")).alias("inked"))
    for side in ("a", "b"):
        own = ink.select("image", F.col("x").cast("bigint").alias(side), F.col("inked").alias(f"{side}_inked"))
        state = F.when(F.col(f"{side}_inked").isNull(), "outside").when(F.col(f"{side}_inked"), "inked").otherwise("blank")
        apart = apart.join(own, ["image", side], "left").withColumn(f"{side}_state", state).drop(f"{side}_inked")
    return apart


def contingency(states: DataFrame, *by: str) -> DataFrame:
    """How often each side's cut, both, one alone or neither lies in a blank."""
    a, b = F.col("a_state"), F.col("b_state")
    return states.groupBy(*by).agg(
        F.count("*").alias("cuts"), F.count_if(a == "blank").alias("a_blank"), F.count_if(a == "outside").alias("a_outside"), F.count_if(b == "blank").alias("b_blank"), F.count_if(b == "outside").alias("b_outside"),
        F.count_if((a == "blank") & (b == "blank")).alias("both_blank"), F.count_if((a == "blank") & (b == "inked")).alias("only_a"), F.count_if((a == "inked") & (b == "blank")).alias("only_b"), F.count_if((a == "inked") & (b == "inked")).alias("neither"),
    )


@F.pandas_udf(T.StructType([T.StructField("ink", T.LongType()), T.StructField("outside", T.LongType())]))
def _row_ink(row: pd.Series, below: pd.Series, spans: pd.Series) -> pd.DataFrame:
    """Ink pixels of image rows, and those outside the spans [from, to]: spans are merged, and counts are differences of the
    row's running sum."""
    out = []
    for grey, level, own in zip(row, below, spans):
        upto = np.append(0, np.cumsum(np.asarray(grey) < level))
        covered = reach = 0
        for x0, x1 in sorted((s["x0"], s["x1"]) for s in own) if own is not None else ():
            x0, x1 = max(x0, reach), min(x1 + 1, len(grey))
            if x0 < x1:
                covered += int(upto[x1] - upto[x0])
                reach = x1
        out.append((int(upto[-1]), int(upto[-1]) - covered))
    return pd.DataFrame(out, columns=["ink", "outside"])


def uncovered(images: DataFrame, boxes: DataFrame, levels: DataFrame, grown: float = GROWN) -> DataFrame:
    """(image, ink, outside, uncovered): the share of an image's ink that no box (image, hpos, vpos, width, height, and scale_x,
    scale_y to pixels) covers once boxes have grown to every side; 0 without ink.

    Edges are cut to whole pixels toward zero, and both belong to the box."""
    edge = lambda at, by, scale: ((F.col(at) + by) * F.col(scale)).cast("bigint")
    dx, dy = F.col("width") * grown, F.col("height") * grown
    size = images.groupBy("image").agg(F.max("y").alias("last"))
    spans = boxes.join(size, "image").select("image", edge("hpos", -dx, "scale_x").alias("x0"), edge("hpos", F.col("width") + dx, "scale_x").alias("x1"), F.greatest(edge("vpos", -dy, "scale_y"), F.lit(0)).alias("y0"), F.least(edge("vpos", F.col("height") + dy, "scale_y"), F.col("last")).alias("y1"))
    rows = spans.where("y0 <= y1").select("image", "x0", "x1", F.explode(F.sequence("y0", "y1")).alias("y")).groupBy("image", "y").agg(F.collect_set(F.struct("x0", "x1")).alias("spans"))  # at most the row's pixels squared
    counted = images.join(levels, "image").join(rows, ["image", "y"], "left").select("image", _row_ink("row", "below", "spans").alias("r"))
    total = counted.groupBy("image").agg(F.sum("r.ink").alias("ink"), F.sum("r.outside").alias("outside"))
    share: Column = F.when(F.col("ink") > 0, F.col("outside") / F.col("ink")).otherwise(F.lit(0.0))
    return total.withColumn("uncovered", share)
