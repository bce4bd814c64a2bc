"""Page triage from line boxes (file, ord, hpos, vpos, width, height, page_width)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import vertical_overlap
from .matching import meeting


@dataclass(frozen=True)
class Thresholds:
    fused_ratio: float = 2.2
    max_fused: float = 0.05
    wide_ratio: float = 1.35
    max_wide: float = 0.05
    max_disorder: float = 0.10
    max_gaps: float = 0.10
    gap_ratio: float = 0.06
    min_lines: int = 8


def column_widths(boxes: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """(file, column_width): left edges are sessions over x; the distance of column starts, or the text block's width."""
    x = Window.partitionBy("file").orderBy("hpos")
    jump = F.coalesce(F.col("hpos") - F.lag("hpos").over(x) > t.gap_ratio * F.greatest(F.lit(1), "page_width"), F.lit(False))
    grouped = boxes.withColumn("jump", jump.cast("int")).withColumn("session", F.sum("jump").over(x.rangeBetween(Window.unboundedPreceding, 0)))
    # A jump is between edges, so lines with equal edges share a session.
    sessions = grouped.groupBy("file", "session").agg(F.count("*").alias("n"), F.min("hpos").alias("start"))
    per = Window.partitionBy("file")
    populated = sessions.withColumn("full", F.max((F.col("n") >= t.min_lines).cast("int")).over(per)).where((F.col("n") >= t.min_lines) | (F.col("full") == 0))
    starts = populated.withColumn("step", F.col("start") - F.lag("start").over(per.orderBy("start")))
    spacing = starts.groupBy("file").agg(F.count("*").alias("columns"), F.floor(F.percentile("step", F.lit(0.5))).cast("bigint").alias("spacing"))
    members = grouped.join(populated.select("file", "session"), ["file", "session"]).groupBy("file").agg(F.percentile("width", F.lit(0.5)).alias("typical"))
    block = boxes.groupBy("file").agg((F.max(F.col("hpos") + F.col("width")) - F.min("hpos")).alias("block"))
    fits = (F.col("columns") >= 2) & (F.col("typical") <= t.wide_ratio * F.col("spacing"))
    return block.join(spacing, "file").join(members, "file").select("file", F.when(fits, F.col("spacing")).otherwise(F.col("block")).alias("column_width"))


def triage(boxes: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """One verdict for each file: shares of fused, wide, disordered and skipped lines, and the reasons to refuse."""
    stats = boxes.groupBy("file").agg(F.count("*").alias("lines"), F.percentile("height", F.lit(0.5)).alias("mid"), F.min("hpos").alias("left"))
    rows = boxes.join(stats, "file").join(column_widths(boxes, t), "file")
    order = Window.partitionBy("file").orderBy("ord")
    col = F.when(F.col("column_width") > 0, ((F.col("hpos") + F.col("width") / 2 - F.col("left")) / F.col("column_width")).cast("bigint"))
    seq = rows.withColumn("col", col)
    seq = seq.withColumn("pcol", F.lag("col").over(order)).withColumn("pv", F.lag("vpos").over(order)).withColumn("ph", F.lag("height").over(order))
    back = ((F.col("col") == F.col("pcol")) & (F.col("vpos") < F.col("pv") - F.col("ph"))) | (F.col("col") < F.col("pcol"))
    pitch = F.when((F.col("col") == F.col("pcol")) & (F.col("vpos") > F.col("pv")), F.col("vpos") - F.col("pv"))
    seq = seq.withColumn("back", F.coalesce(back, F.lit(False))).withColumn("pitch", pitch)
    pitches = seq.groupBy("file").agg(F.percentile("pitch", F.lit(0.5)).alias("usual"))
    body = seq.join(pitches, "file").groupBy("file", "lines", "column_width").agg(
        F.avg((F.col("height") > t.fused_ratio * F.col("mid")).cast("double")).alias("fused"),
        F.avg(((F.col("column_width") > 0) & (F.col("width") > t.wide_ratio * F.col("column_width"))).cast("double")).alias("wide"),
        F.count_if("back").alias("n_back"), F.count("pitch").alias("n_pitch"), F.count_if(F.col("pitch") > 3 * F.col("usual")).alias("n_big"),
    )
    disorder = F.when(F.col("lines") > 1, F.col("n_back") / (F.col("lines") - 1)).otherwise(F.lit(0.0))
    gap_share = F.when((F.col("lines") >= 3) & (F.col("n_pitch") > 0), F.col("n_big") / F.col("n_pitch")).otherwise(F.lit(0.0))
    out = body.withColumn("disorder", disorder).withColumn("gaps", gap_share)
    few = F.col("lines") < 2
    for c in ("fused", "wide", "disorder", "gaps"):
        out = out.withColumn(c, F.when(few, 0.0).otherwise(F.col(c)))
    reasons = F.array_compact(F.array(
        F.when(few, "few lines"), F.when(F.col("fused") > t.max_fused, "fused"), F.when(F.col("wide") > t.max_wide, "wide"),
        F.when(F.col("disorder") > t.max_disorder, "disorder"), F.when(F.col("gaps") > t.max_gaps, "gaps"),
    ))
    return out.select("file", "lines", F.when(few, 0).otherwise(F.col("column_width")).cast("bigint").alias("column_width"), "fused", "wide", "disorder", "gaps", (F.size(reasons) == 0).alias("accepted"), F.array_join(reasons, ",").alias("reasons"))


def lines_to_resegment(boxes: DataFrame, max_overlap: float = 0.35, fused_ratio: float | None = None) -> DataFrame:
    """(file, ord, overlap, reason): lines that a neighbour covers by too much, or that are too tall.

    Boxes meet in bands of their own height, so neither many lines nor one tall box pair a page whole."""
    rows = boxes.join(boxes.groupBy("file").agg(F.percentile("height", F.lit(0.5)).alias("mid")), "file")
    flat = boxes.select("file", "ord", "hpos", "vpos", "width", "height", F.col("vpos").alias("y0"), (F.col("vpos") + F.col("height")).alias("y1"))
    share = vertical_overlap(*({c: F.col(f"{k}_{c}") for c in ("hpos", "vpos", "width", "height")} for k in "ab"))
    met = meeting(flat, flat).where("a_ord != b_ord").groupBy("file", F.col("a_ord").alias("ord")).agg(F.max(share).alias("overlap"))
    out = rows.join(met, ["file", "ord"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))
    tall_reason = F.when((F.col("mid") > 0) & (F.col("height") > fused_ratio * F.col("mid")), "height") if fused_ratio is not None else F.lit(None)
    reason = F.when(F.col("overlap") > max_overlap, "overlap").otherwise(tall_reason)
    return out.withColumn("reason", reason).where("reason is not null").select("file", "ord", "overlap", "reason")
