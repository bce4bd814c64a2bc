"""The frozen decision rule over pairs of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUIRED, SLACK = 3, 1e-9


def beyond_half(within: Column, boundaries: Column, failures: Column) -> Column:
    """Share of boundaries beyond half a character; a failure counts as one of them."""
    scored = boundaries + failures
    return F.when(scored > 0, ((1.0 - within) * boundaries + failures) / scored).otherwise(F.lit(1.0))


def outcomes(reports: DataFrame) -> DataFrame:
    """One row for each corpus from reports with ``b_`` (baseline) and ``c_`` (candidate) columns."""
    base, cand = (beyond_half(F.col(f"{k}_within_half_char"), F.col(f"{k}_boundaries"), F.col(f"{k}_failures")) for k in "bc")
    why = F.when(F.col("b_boundaries") == 0, "baseline is empty").when(F.col("c_boundaries") == 0, "candidate is silent")
    return reports.select("corpus", base.alias("b_beyond"), cand.alias("c_beyond"), why.alias("incomparable"), (cand <= base / 2 + SLACK).alias("halved"), (F.col("c_worst") <= F.col("b_worst") + SLACK).alias("worst_not_worse"))


def decide(rows: DataFrame) -> DataFrame:
    """(outcome, corpora, halved): one row.  The order of the rules is part of the rule."""
    one = rows.agg(F.count("*").alias("corpora"), F.count_if(F.col("incomparable").isNotNull()).alias("odd"), F.count_if(~F.col("worst_not_worse")).alias("worse"), F.count_if("halved").alias("halved"))
    outcome = F.when((F.col("corpora") < REQUIRED) | (F.col("odd") > 0), "INCOMPLETE").when(F.col("worse") > 0, "REFUTED").when(F.col("halved") >= 2, "CONFIRMED").otherwise("REFUTED")
    return one.select(outcome.alias("outcome"), "corpora", "halved", "worse")
