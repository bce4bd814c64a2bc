"""Registered queries over ink, on images made of ``embeddings``: sixteen vectors are an image's rows of grey values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ink

ROWS = 16


def images(s: SparkSession, d: str) -> DataFrame:
    """(image, y, row): values from -0.3 to 0.3 become greys from 0 to 255; every fourth block of eight columns is lightened."""
    grey = lambda v, i: F.least(F.greatest(F.floor((v.cast("double") + F.lit(0.3)) * F.lit(425.0)) + F.when(F.floor(i / 8) % 4 == 3, 200).otherwise(0), F.lit(0)), F.lit(255)).cast("int")
    vectors = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").where("vec_id is not null and embedding is not null")
    return vectors.select(F.floor(F.col("vec_id") / ROWS).alias("image"), (F.col("vec_id") % ROWS).cast("bigint").alias("y"), F.transform("embedding", grey).alias("row"))


def ink_runs(s: SparkSession, d: str) -> DataFrame:
    """Thresholds by both rules and the blank runs that each leaves."""
    rows = images(s, d)
    levels, columns, heights = ink.thresholds(rows), ink.columns(rows), rows.groupBy("image").agg((F.max("y") + 1).alias("height"))
    runs = [ink.blank_runs(columns, levels, heights, strict).withColumn("rule", F.lit(rule)) for strict, rule in ((False, "at"), (True, "below"))]
    per = runs[0].unionByName(runs[1]).groupBy("image", "rule").agg(F.count("*").alias("runs"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))
    every = levels.select("image", F.inline(F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(rule).cast("bigint").alias("level")) for rule in ("at", "below")])))
    return every.join(per, ["image", "rule"], "left").fillna(0, ["runs", "starts", "ends"])


def ink_under_cuts(s: SparkSession, d: str) -> DataFrame:
    """Of cuts that two resolvers place far apart, how many lie in blanks."""
    rows = images(s, d)
    cuts = rows.select("image", F.col("y").alias("k"), ((F.col("image") * 7 + F.col("y") * 11) % 70 - 3).alias("a"), ((F.col("image") * 5 + F.col("y") * 23) % 66).alias("b"))
    states = ink.cut_states(cuts, ink.columns(rows), ink.thresholds(rows))
    return ink.contingency(states.withColumn("part", F.col("k") % 4), "part")


def uncovered_ink(s: SparkSession, d: str) -> DataFrame:
    """The share of each image's ink that three boxes of a page twice as large leave out."""
    rows = images(s, d)
    box = lambda x, y, w, h: F.struct(x.alias("hpos"), y.alias("vpos"), w.alias("width"), h.alias("height"))
    k = F.col("image")
    each = F.array(box(k % 9, F.lit(2), 40 + k % 7, F.lit(8)), box(30 + k % 5, 6 + k % 3, F.lit(60), F.lit(12)), box(F.lit(100), 20 + k % 8, 10 + k % 31, F.lit(10)))
    boxes = rows.select("image").distinct().select("image", F.inline(each)).withColumns({"scale_x": F.lit(0.5), "scale_y": F.lit(0.5)})
    return ink.uncovered(rows, boxes, ink.thresholds(rows)).withColumn("uncovered", F.round("uncovered", 6))


def queries() -> dict:
    return {f.__name__: f for f in (ink_runs, ink_under_cuts, uncovered_ink)}
