"""Pixel-blind resolvers: where do a case's tokens lie, given only its box?

``registry`` maps names to resolvers, which add ``boxes`` to cases; widths are worked out for Arrow batches of cases at once
(:mod:`pagewright.functions.arrays`).  Integer weights (10 a character, 6 a space) keep the sums exact; the boundary of token k
is rounded half to even from the running sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import distributed_of, proportional_of, weighted_of

BOX = ("box_hpos", "box_width")


def _resolved(cases: DataFrame, boxes) -> DataFrame:
    return cases.withColumn("boxes", boxes).withColumn("error", F.lit(None).cast("string"))


def resolve_proportional(cases: DataFrame) -> DataFrame:
    """Adds up ``weight * unit`` with the weights 1 and 0.6 and one unit for the whole box."""
    return _resolved(cases, proportional_of("tokens", *BOX))


def resolve_distributed(cases: DataFrame) -> DataFrame:
    """Exact integer weights, one division a boundary."""
    return _resolved(cases, distributed_of("tokens", *BOX))


def resolve_weighted(cases: DataFrame, weights: str) -> DataFrame:
    """One division a boundary, by a column of weights, one for each token."""
    return _resolved(cases, weighted_of("tokens", *BOX, weights))


registry = {"proportional": resolve_proportional, "distributed": resolve_distributed}


def coalesced(first: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """The first resolver's boxes where it gave any, else the fallback's."""
    other = fallback.select(*keys, F.col("boxes").alias("_boxes"))
    return first.join(other, keys, "left").withColumn("boxes", F.coalesce("boxes", "_boxes")).drop("_boxes")


def fallen_back(first: DataFrame, fallback) -> DataFrame:
    """The boxes that cases have, else those of the ``fallback`` resolver, case by case: nothing is joined or shuffled."""
    other = fallback(first.withColumnRenamed("boxes", "_boxes").drop("error"))
    return other.withColumn("boxes", F.coalesce("_boxes", "boxes")).drop("_boxes")
