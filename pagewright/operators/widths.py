"""Letter widths learned from a page: medians of advances, and a trimmed ridge fit with cross-fitting by line parity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alignment import coded, fold_codes
from ..functions.arrays import advance_counts
from ..functions.columns import is_space
from ..functions.kernels import folded
from .resolvers import resolve_weighted

MODEL = "corpus string, file long, parity int, glyphs map<string,double>, constant double, space double, unit double"


def learn_advances(cuts: DataFrame, *by: str) -> DataFrame:
    """(by, glyph, advance, n) from cuts (file, line_ord, text, spans), one row a line: the distance to the next character's start
    against the line's median, then the median of each folded character, of all cuts or by ``by``.

    A line's own figures are worked out where the line is; what is shuffled are counts of distinct advances."""
    rows = cuts.select(*by, "text", "spans")
    named = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in by)
    counts = rows.mapInArrow(advance_counts(by), named + "glyph string, advance double, n long").groupBy(*by, "glyph", "advance").agg(F.sum("n").alias("n"))
    return counts.groupBy(*by, "glyph").agg(F.percentile("advance", F.lit(0.5), F.col("n")).alias("advance"), F.sum("n").alias("n"))


def ridge(counts: np.ndarray, widths: np.ndarray, unit: float) -> np.ndarray:
    """Least squares with a faint pull of every glyph to the unit and of the constant (last column) to 0."""
    gram = counts.T @ counts
    pull = 1e-6 * max(1.0, np.trace(gram) / gram.shape[0])
    goal = np.full(gram.shape[0], unit)
    goal[-1] = 0.0
    return np.linalg.solve(gram + pull * np.eye(gram.shape[0]), counts.T @ widths + pull * goal)


def fit(texts: list[str], widths: np.ndarray, blanks: np.ndarray) -> tuple[dict[str, float], float, float, float]:
    """(glyph widths, constant, space, unit): fitted twice, the second time without boxes that don't add up."""
    codes, at = coded(texts)
    letters, own, *rest = fit_letters(fold_codes(codes), np.diff(at), widths, blanks)
    return dict(zip(map(chr, letters.tolist()), own.tolist())), *rest


def fit_letters(codes: np.ndarray, size: np.ndarray, widths: np.ndarray, blanks: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """(letters, their widths, constant, space, unit) from the folded code points of texts of some sizes; see :func:`fit`."""
    widths, size = widths[size > 0], size[size > 0]
    if not len(size):
        return np.zeros(0, np.int64), np.zeros(0), 0.0, 0.6, 1.0
    letters, place = np.unique(codes, return_inverse=True)
    counts = np.bincount(np.repeat(np.arange(len(size)), size) * (len(letters) + 1) + place, minlength=len(size) * (len(letters) + 1)).reshape(len(size), -1).astype(float)
    counts[:, -1] = 1
    unit = float(widths.sum() / counts.sum())
    beta = ridge(counts, widths, unit)
    off = widths - counts @ beta
    spread = np.abs(off - np.median(off))
    good = spread <= max(3 * 1.4826 * float(np.median(spread)), 1.0)
    if not good.all() and good.sum() >= len(letters) + 1:
        seen = np.append((counts[good, :-1] > 0).any(0), True)
        again = ridge(counts[good][:, seen], widths[good], unit)
        beta[seen] = again
    floor = 0.05 * unit
    space = max(floor, float(np.median(blanks))) if len(blanks) else 0.6 * unit
    return letters.astype(np.int64), np.maximum(floor, beta[:-1]), max(0.0, float(beta[-1])), space, unit


def cross_fit(lines: DataFrame) -> DataFrame:
    """A model for each page and line parity, fitted on the page's lines of the other parity."""
    order = Window.partitionBy("corpus", "file").orderBy("line_ord")
    rows = lines.withColumn("parity", ((F.row_number().over(order) - 1) % 2).cast("int"))

    def learn(key, page: pd.DataFrame) -> pd.DataFrame:
        texts = [w["text"] for ws in page["words"] for w in ws]
        widths = np.array([w["width"] for ws in page["words"] for w in ws], float)
        blanks = np.array([b["hpos"] - a["hpos"] - a["width"] for ws in page["words"] for a, b in zip(ws, ws[1:])], float)
        glyphs, constant, space, unit = fit(texts, widths, blanks)
        return pd.DataFrame([(key[0], key[1], 1 - key[2], glyphs, constant, space, unit)], columns=["corpus", "file", "parity", "glyphs", "constant", "space", "unit"])

    return rows.select("corpus", "file", "parity", "words").groupBy("corpus", "file", "parity").applyInPandas(learn, MODEL)


def parities(lines: DataFrame) -> DataFrame:
    """(corpus, file, line_ord, parity) by the order of each page's lines."""
    order = Window.partitionBy("corpus", "file").orderBy("line_ord")
    return lines.select("corpus", "file", "line_ord", ((F.row_number().over(order) - 1) % 2).cast("int").alias("parity"))


def in_pages(cases: DataFrame) -> DataFrame:
    """Cases of whole lines with their ``parity`` by the order of their page's cases, as :func:`parities` gives it."""
    order = Window.partitionBy("corpus", "file").orderBy("line_ord")
    return cases.withColumn("parity", ((F.row_number().over(order) - 1) % 2).cast("int"))


def resolve_learned(cases: DataFrame, lines: DataFrame) -> DataFrame:
    """Cases laid out by their page's own letter widths, never learned from their own half."""
    rows = cases.join(parities(lines), ["corpus", "file", "line_ord"]).join(cross_fit(lines), ["corpus", "file", "parity"], "left")
    glyph = lambda c: F.coalesce(F.try_element_at("glyphs", c), F.col("unit"))
    letters = lambda t: F.split(t, "")
    rows = rows.withColumn("folded", F.transform(F.split(folded(F.array_join("tokens", "\n")), "\n"), lambda t: t))
    pairs = F.zip_with("tokens", "folded", lambda t, f: F.struct(t.alias("t"), f.alias("f")))
    weights = F.transform(pairs, lambda p: F.when(is_space(p["t"]), F.length(p["t"]) * F.col("space")).otherwise(F.col("constant") + F.aggregate(letters(p["f"]), F.lit(0.0), lambda a, c: a + glyph(c))))
    laid = resolve_weighted(rows.withColumn("_weights", weights), "_weights")
    return laid.withColumn("boxes", F.when(F.col("glyphs").isNotNull(), F.col("boxes"))).withColumn("error", F.when(F.col("glyphs").isNull(), "no model")).drop("_weights", "folded", "glyphs", "constant", "space", "unit", "parity")
