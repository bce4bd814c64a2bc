"""Judging against a truth of its own geometry: boxes that meet by overlap, lines that meet by id, words by place.

Lines are rows with ``words``, arrays of structs (text, hpos, width).  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import right
from .matching import overlapping

#: Values that one task orders span this share of the unit.
PART = 1 / 32


def independent_errors(found: Column, truth: Column) -> Column:
    """For each blank the distance of the middle between two found words from the blank between the same two true words,
    in characters of the true line; null if the counts differ, there are fewer than two words, or the line has no width."""
    n = F.size(truth)
    chars = F.aggregate(truth, n - 1, lambda a, w: a + F.length(w["text"]))
    unit = (right(F.element_at(truth, -1)) - F.element_at(truth, 1)["hpos"]) / chars
    pairs = lambda words: F.zip_with(F.slice(words, 1, n - 1), F.slice(words, 2, n - 1), lambda a, b: F.struct(right(a).alias("lo"), b["hpos"].alias("hi")))

    def distance(got: Column, gap: Column) -> Column:
        middle = (got["lo"] + got["hi"]) / 2
        return F.greatest(F.least(gap["lo"], gap["hi"]) - middle, middle - F.greatest(gap["lo"], gap["hi"]), F.lit(0.0)) / unit

    return F.when((F.size(found) == n) & (n >= 2), F.when(unit > 0, F.zip_with(pairs(found), pairs(truth), distance)))


def edges_of(found: Column, truth: Column, place: Column) -> Column:
    """(left, right): how far the edges of the found word at ``place`` (from 1) lie from the true word's, in mean widths of a
    true character; null if the counts differ or there is no such word."""
    width = F.aggregate(truth, F.lit(0).cast("bigint"), lambda a, w: a + w["width"])
    unit = width / F.aggregate(truth, F.lit(0).cast("bigint"), lambda a, w: a + F.length(w["text"]))
    a, b = F.try_element_at(found, place), F.try_element_at(truth, place)
    return F.when((F.size(found) == F.size(truth)) & b.isNotNull(), F.struct((F.abs(a["hpos"] - b["hpos"]) / unit).alias("left"), (F.abs(right(a) - right(b)) / unit).alias("right")))


def at_places(each: DataFrame, by: list[str], value: str, **places) -> DataFrame:
    """One row for each group: n, within (the share of at most half a character), mean, and exact order statistics of
    ``value``: each of ``places`` turns the count into a place from 0.

    Equal values are counted first; the counts of narrow ranges tell how many values lie before a range, so that a task
    orders one range's distinct values, not a group's.  Nulls don't count."""
    v = F.col(value)
    counts = each.where(v.isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c")).withColumn("part", F.floor(v / PART))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("c").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.groupBy(*by, "part").agg(F.sum("c").alias("c")).select(*by, "part", before.alias("before"), F.sum("c").over(group).alias("total"))
    own = F.sum("c").over(Window.partitionBy(*by, "part").orderBy(value))
    placed = counts.join(parts, [*by, "part"]).withColumn("upto", F.col("before") + own)
    shares = [F.sum("c").alias("n"), (F.sum(F.when(v <= 0.5, F.col("c")).otherwise(0)) / F.sum("c")).alias("within"), (F.sum(v * F.col("c")) / F.sum("c")).alias("mean")]
    return placed.groupBy(*by).agg(*shares, *[F.min(F.when(F.col("upto") > place(F.col("total")), v)).alias(name) for name, place in places.items()])


STRETCH = "corpus string, part long, place long, n long, within double, mean double"


def stretches(parts: DataFrame, place) -> DataFrame:
    """(corpus, part, place, n, within, mean) from counts of narrow stretches of errors (corpus, part, n, within, total): the stretch that
    has a corpus's order statistic, and its place there; ``place`` turns the corpus's count into the statistic's place from 0."""
    counts = parts.groupBy("corpus", "part").agg(*[F.sum(c).alias(c) for c in ("n", "within", "total")])
    group = Window.partitionBy("corpus")
    whole = [F.sum(c).over(group).alias(f"_{c}") for c in ("n", "within", "total")]
    rows = counts.select("corpus", "part", F.col("n").alias("own"), F.sum("n").over(group.orderBy("part")).alias("upto"), *whole).withColumn("place", place(F.col("_n")) - F.col("upto") + F.col("own"))
    return rows.where("place >= 0 and place < own").select("corpus", "part", "place", F.col("_n").alias("n"), (F.col("_within") / F.col("_n")).alias("within"), (F.col("_total") / F.col("_n")).alias("mean"))


def picked(each: DataFrame, wanted: DataFrame) -> DataFrame:
    """(corpus, n, within, mean, p90) from counts of the errors (corpus, e, c) of :func:`stretches`."""
    counts = each.groupBy("corpus", "e").agg(F.sum("c").alias("c")).withColumn("upto", F.sum("c").over(Window.partitionBy("corpus").orderBy("e")))
    held = counts.withColumnRenamed("corpus", "_corpus")
    met = wanted.join(held, F.col("corpus").eqNullSafe(F.col("_corpus"))).where("upto > place")
    return met.groupBy("corpus", "n", "within", "mean").agg(F.min("e").alias("p90"))


def summary(each: DataFrame, by: list[str], value: str = "e") -> DataFrame:
    """n, the share within half a character, the mean and the value at 0.9 * (n - 1), cut to a whole place."""
    return at_places(each, by, value, p90=lambda n: F.floor(0.9 * (n - 1)))


def share_place(share: float):
    """The place of a quantile as ``min(n - 1, n * share)``, cut to a whole number."""
    return lambda n: F.least(n - 1, F.floor(share * n))


def attached_truth(lines: DataFrame, truth: DataFrame, least: float = 0.2) -> DataFrame:
    """(file, id, truth, kind): for each box the texts (``gt``) of the true boxes that it overlaps enough, from the top and
    then from the left, with one space between them; kind is ``1:1``, ``fusion`` or ``none`` (then truth is null)."""
    pairs = overlapping(lines, truth, least).join(truth.select("file", F.col("id").alias("b_id"), "y0", "x0", "gt"), ["file", "b_id"])
    held = pairs.groupBy("file", F.col("a_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "b_id", "gt"))).alias("held"))
    text = F.array_join(F.transform("held", lambda x: x["gt"]), " ")
    kind = F.when(F.size("held") >= 2, "fusion").when(F.col("held").isNotNull(), "1:1").otherwise("none")
    return lines.select("file", "id").join(held, ["file", "id"], "left").select("file", "id", text.alias("truth"), kind.alias("kind"))


def judgeable(source: DataFrame, returned: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Lines (keys, text) that have a text in both source and truth, with what was returned for them, else the source."""
    some = lambda frame, name: frame.where(F.col("text").rlike(r"(?U)\S")).select(*keys, F.col("text").alias(name))
    both = some(source, "source").join(some(truth, "truth"), keys)
    got = both.join(returned.select(*keys, F.col("text").alias("got")), keys, "left")
    return got.select(*keys, "source", F.coalesce("got", "source").alias("returned"), "truth")


def scale_state(image: Column, page: Column, scale: Column) -> Column:
    """Whether a scale between a page's units and an image's pixels holds: ``ok`` or ``off`` if the page's width is known (0 counts as
    unknown) and the ratio is within 0.02 of the scale or isn't, else ``stated`` or, without a scale, ``unknown``."""
    known = F.when(page > 0, page)
    return F.when(known.isNotNull(), F.when(F.abs(image / known - F.coalesce(scale, F.lit(1.0))) <= 0.02, "ok").otherwise("off")).when(scale.isNotNull(), "stated").otherwise("unknown")


def to_pixel(value: Column, scale: Column, size: Column) -> Column:
    """A coordinate in pixels, rounded half to even and kept inside the image."""
    return F.greatest(F.lit(0).cast("bigint"), F.least(size - 1, F.rint(value * scale).cast("bigint")))
