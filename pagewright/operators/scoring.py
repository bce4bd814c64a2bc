"""Scores of resolved cases: distances of predicted blanks from true ones, and their distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import error_counts
from ..functions.columns import interval_distance
from ..functions.requests import COUNTS


def boundary_errors(boxes: Column, gaps: Column) -> Column:
    """Distance of the middle of space token 2k + 1 from true gap k; null if the counts disagree."""
    n = F.size(gaps)
    middle = lambda k: F.element_at(boxes, 2 * k + 2)["hpos"] + F.element_at(boxes, 2 * k + 2)["width"] / 2
    each = F.transform(gaps, lambda g, k: interval_distance(middle(k), middle(k), g["start"], g["end"]))
    return F.when(F.size(boxes) == 2 * n + 1, each)


def scored(resolved: DataFrame) -> DataFrame:
    """Adds ``errors`` (null for a failure) and ``unit``, the mean width of a character of the case."""
    unit = F.when(F.col("n_chars") > 0, F.col("box_width") / F.col("n_chars")).otherwise(F.lit(0.0))
    return resolved.withColumn("errors", F.when(F.col("error").isNull(), boundary_errors(F.col("boxes"), F.col("gaps")))).withColumn("unit", unit)


def report(cases: DataFrame, *by: str, upper: bool = False) -> DataFrame:
    """The distribution report of scored cases, one row for each value of ``by``; with ``upper`` the median of an even number is the
    upper of the two in the middle.

    One scan counts, by Arrow batches and then in all, for each distinct error of a group, how often it occurs; all figures, the order statistics too, come
    from these counts.  Errors are halves of pixels, so a group has few distinct ones."""
    keys = list(by)
    rows = cases.select(*keys, F.col("unit").cast("double").alias("unit"), F.col("errors").cast("array<double>").alias("errors"))
    named = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in keys)
    return reported(rows.mapInArrow(error_counts(tuple(keys)), named + COUNTS), *keys, upper=upper)


def reported(each: DataFrame, *by: str, upper: bool = False) -> DataFrame:
    """:func:`report` from counts of errors (by, and the columns of ``COUNTS``)."""
    keys = list(by)
    counts = each.groupBy(*keys, "e").agg(*[F.sum(c).alias(c) for c in ("cases", "failures", "c", "sized", "chars", "within")])
    group = Window.partitionBy(*keys)
    placed = counts.withColumn("upto", F.sum("c").over(group.orderBy(F.asc_nulls_first("e")))).withColumn("total", F.sum("c").over(group))
    nth = lambda place: F.min(F.when(F.col("upto") > place, F.col("e")))
    total = F.col("total")
    shares = placed.groupBy(*keys).agg(
        F.sum("cases").alias("cases"), F.sum("failures").alias("failures"), F.sum("c").alias("boundaries"), (F.sum(F.col("e") * F.col("c")) / F.sum("c")).alias("mean"),
        ((nth(F.floor((total if upper else total - 1) / 2)) + nth(F.floor(total / 2))) / 2).alias("median"), F.max("e").alias("worst"),
        (F.sum("chars") / F.sum("sized")).alias("mean_chars"), (F.sum("within") / F.sum("sized")).alias("within_half_char"), nth(F.floor(0.9 * (total - 1) + 0.5)).alias("p90"),
    )
    return shares.fillna(0.0, ["mean", "median", "p90", "worst", "mean_chars", "within_half_char"])


def edge_errors(resolved: DataFrame) -> DataFrame:
    """For lines whose words mostly touch: the distance of each later word's predicted left edge from its true one."""
    own = F.filter("boxes", lambda b, i: i % 2 == 0)
    each = F.zip_with(own, "words", lambda b, w: F.abs(b["hpos"] - w["hpos"]))
    return resolved.withColumn("edges", F.slice(each, 2, F.size("words")))


def tiling(words: Column, gaps: Column) -> Column:
    """Whether more than half of the blanks are empty, so that edges, not middles, are scored."""
    return F.size(F.filter(gaps, lambda g: g["end"] - g["start"] <= 0)) * 2 > F.size(gaps)


def moved(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Boundaries whose error differs between two resolvers, cases that either failed left out."""
    both = a.select(*keys, F.col("errors").alias("x")).join(b.select(*keys, F.col("errors").alias("y")), keys)
    return both.agg(F.sum(F.size(F.filter(F.zip_with("x", "y", lambda p, q: F.abs(p - q)), lambda d: d > 1e-9))).alias("moved"), F.sum(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.size("x"))).alias("boundaries"))
