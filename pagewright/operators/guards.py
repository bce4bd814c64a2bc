"""Guards against invented text in corrections: what each threshold would stop, and what that would cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import edits_of, support_of
from ..functions.likeness import unanchored_runs_of

LIMITS, INVENTED = (2, 3, 4), 3
RECOURSE = 0.60
KEY = ("corpus", "page", "ord", "output")


def edits(a: str, b: str) -> Column:
    """Edits between two texts; null if either is."""
    return edits_of(a, b)


def corrections(rows: DataFrame) -> DataFrame:
    """Distinct corrections of result rows (corpus, producer, turn, page, ord, source, output, truth), one row for each
    (corpus, page, ord, output) that differs from its source: how many rows have it, how many of them are better than their
    source, what reverting them all would save, and of the last one (by turn, then producer) its figures.

    Texts are aligned once for each correction, not for each row."""
    changed = rows.where(~F.col("output").eqNullSafe(F.col("source"))).withColumn("before", edits("source", "truth")).withColumn("after", edits("output", "truth"))
    last = F.max_by(F.struct("producer", "source", "truth", "before", "after"), F.struct("turn", "producer")).alias("last")
    each = changed.groupBy(*KEY).agg(F.count("*").alias("rows"), F.count_if(F.col("after") < F.col("before")).alias("better"), F.sum(F.col("before") - F.col("after")).alias("saved"), last)
    runs = each.withColumn("x", unanchored_runs_of("last.source", "output", "last.truth"))
    return runs.select(*KEY, "rows", "better", "saved", "last.producer", (F.col("last.after") < F.col("last.before")).alias("good"), "x.run", "x.invented")


def guard_report(rows: DataFrame, limits: tuple[int, ...] = LIMITS) -> DataFrame:
    """By corpus and limit: rows changed and better, corrections, those that invent, and what a guard that stops longer unanchored
    runs than the limit would stop, with the error rate if it gave the source back.  All limits come from one aggregate."""
    faulty = F.col("invented") >= INVENTED
    figures = [F.sum("rows").alias("changed"), F.sum("better").alias("better"), F.count("*").alias("corrections"), F.count_if(faulty).alias("faulty")]
    for limit in limits:
        hit = F.col("run") > limit
        figures.append(F.struct(
            F.lit(limit).alias("limit"), F.coalesce(F.sum(F.when(hit, F.col("rows"))), F.lit(0)).alias("stopped_rows"), F.count_if(hit).alias("stopped"), F.count_if(hit & faulty).alias("stopped_faulty"),
            F.count_if(hit & F.col("good")).alias("stopped_good"), F.coalesce(F.sum(F.when(hit, F.col("saved"))), F.lit(0)).alias("saved"),
        ).alias(f"limit_{limit}"))
    guards = corrections(rows).groupBy("corpus").agg(*figures)
    each = guards.select("corpus", "changed", "better", "corrections", "faulty", F.explode(F.array(*[f"limit_{k}" for k in limits])).alias("g")).select("*", "g.*").drop("g")
    totals = rows.groupBy("corpus").agg(F.sum(edits("output", "truth")).alias("errors"), F.sum(F.length("truth")).alias("letters"))
    rate = lambda n: n / F.greatest(F.col("letters"), F.lit(1))
    return each.join(totals, "corpus").withColumn("cer", rate(F.col("errors"))).withColumn("cer_reverted", rate(F.col("errors") + F.col("saved"))).drop("errors", "letters", "saved")


def recourse(vetoed: DataFrame, readings: DataFrame, least: float = RECOURSE) -> DataFrame:
    """A second chance for lines that a veto (page, ord, output, verdict) found unlike their source: the share of the output that
    what was read from the image (page, ord, read) accounts for.  Adds ``support`` and ``recourse``: ``given back``, ``refused`` or
    ``no reading``; null for lines that didn't need one."""
    rows = vetoed.join(readings.select("page", "ord", "read"), ["page", "ord"], "left")
    asked = F.col("verdict") == "unlike"
    rows = rows.withColumn("support", F.when(asked & F.col("read").isNotNull(), support_of(F.when(asked, F.col("read")), "output")))
    state = F.when(F.col("support").isNull(), "no reading").when(F.col("support") >= least, "given back").otherwise("refused")
    return rows.withColumn("recourse", F.when(asked, state)).drop("read")
