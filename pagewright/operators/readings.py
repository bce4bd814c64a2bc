"""Resolvers that take positions from a reading of the line: character cuts, an engine's words, learned letter widths.

A reading is a row (keys, read, spans) joined to the requests by key; what becomes of each request is its ``status``:
``read``, ``weak`` (the reading accounts for too little of the text) or ``missing``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import aligned_of
from ..functions.kernels import support_of, transferred
from .resolvers import resolve_proportional
from .scoring import boundary_errors

LEAST_SUPPORT = 0.5
KEYS = ("corpus", "file", "line_ord")


def read_status(cases: DataFrame, readings: DataFrame, keys: tuple[str, ...] = KEYS, least: float = LEAST_SUPPORT) -> DataFrame:
    """Adds ``read``, ``spans``, ``support`` and ``status``, of each case's reading; keys of readings are unique."""
    return status_of(cases.join(readings.select(*keys, "read", "spans"), list(keys), "left"), least)


def status_of(rows: DataFrame, least: float = LEAST_SUPPORT) -> DataFrame:
    """Adds ``support`` and ``status`` to cases that have a reading (``read``, ``spans``; null: none)."""
    rows = rows.withColumn("support", F.when(F.col("read").isNotNull(), support_of("read", F.array_join("tokens", ""))))
    return _with_status(rows, least)


def resolve_read(cases: DataFrame, missing_is_error: bool = True, last_resort: bool = False) -> DataFrame:
    """Boxes for cases with a ``status``: transferred where the line was read, with ``glyphs`` (letter widths against the
    typical one) inside what was not, if there is such a column.

    A weak line falls back on its box, or is the error ``low support`` when asked as a last resort, so that whoever asks
    keeps what it has.  A missing one is an error by the rule of character cuts, and falls back by that of engine words."""
    glyphs = F.col("glyphs") if "glyphs" in cases.columns else F.lit(None).cast("map<string,double>")
    usable = F.col("status") == "read"
    asked = F.struct(F.when(usable, F.col("read")).alias("read"), "spans", "tokens", F.col("box_hpos").alias("hpos"), F.col("box_width").alias("width"), glyphs.alias("glyphs"))
    base = resolve_proportional(cases).drop("error").withColumnRenamed("boxes", "base")
    base = base.withColumn("got", F.col("got.arms")[0] if "got" in cases.columns else transferred(asked))
    refused = F.when(F.col("status") == "missing", F.lit("missing line") if missing_is_error else F.lit(None)).when(F.col("status") == "weak", F.lit("low support") if last_resort else F.lit(None))
    out = base.withColumn("error", F.when(usable, F.col("got.error")).otherwise(refused))
    return out.withColumn("boxes", F.when(usable, F.col("got.boxes")).when(F.col("error").isNull(), F.col("base"))).drop("base", "got")


def _aligned(*glyphs: Column) -> Column:
    return aligned_of("read", "spans", "tokens", "box_hpos", "box_width", F.array(*[g.cast("map<string,double>") for g in glyphs]))


def read_boxes(cases: DataFrame, least: float = LEAST_SUPPORT, **rules) -> DataFrame:
    """:func:`status_of` and :func:`resolve_read` in one pass over cases that have a reading: each is aligned once."""
    rows = cases.withColumn("got", _aligned(F.lit(None))).withColumn("support", F.col("got.support"))
    return resolve_read(_with_status(rows, least), **rules)


def _with_status(rows: DataFrame, least: float) -> DataFrame:
    return rows.withColumn("status", F.when(F.col("read").isNull(), "missing").when(F.col("support") < least, "weak").otherwise("read"))


def relative(models: DataFrame) -> DataFrame:
    """Width models (glyphs, space, unit) with ``glyphs`` scaled so that the upper median letter is 1, the space among them; a
    model without letters scales by its unit."""
    values = F.array_sort(F.map_values("glyphs"))
    middle = F.coalesce(F.try_element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int")), F.col("unit"))
    rows = models.withColumn("scale", F.when(middle > 0, middle).otherwise(F.lit(1.0)))
    letters = F.transform_values(F.map_filter("glyphs", lambda c, _: c != " "), lambda _, w: w / F.col("scale"))
    return rows.withColumn("glyphs", F.map_concat(letters, F.create_map(F.lit(" "), F.col("space") / F.col("scale")))).drop("scale")


def boundary_arms(cases: DataFrame, widths: dict[str, Column], *keys: str, least: float = LEAST_SUPPORT) -> DataFrame:
    """(keys, one error for each name): every boundary of the cases that were read (``read``, ``spans``), transferred under those
    letter widths (null: none); null where an arm failed.  Other cases fall back alike under every arm."""
    rows = cases.where("read is not null").withColumn("got", _aligned(*widths.values())).where(F.col("got.support") >= least)
    arm = lambda k: F.col("got.arms")[k]
    errors = [F.when(arm(k)["error"].isNull(), boundary_errors(arm(k)["boxes"], F.col("gaps"))).alias(name) for k, name in enumerate(widths)]
    return rows.select(*keys, F.explode(F.arrays_zip(*errors)).alias("x")).select(*keys, "x.*")


def moved(boundaries: DataFrame, base: str, other: str, *by: str) -> DataFrame:
    """(by, moved, boundaries): boundaries whose error under one arm isn't the other's, failures of either left out."""
    return boundaries.where(F.col(base).isNotNull() & F.col(other).isNotNull()).groupBy(*by).agg(F.count_if(F.abs(F.col(base) - F.col(other)) > 1e-9).alias("moved"), F.count("*").alias("boundaries"), F.avg(base).alias("mean"), F.avg(other).alias("arm_mean"))
