"""Ground-truth cases: windows of neighbouring words whose boundaries are known."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import window_batches
from ..functions.columns import WORDS, right

KEYS = ["corpus", "file", "line_ord"]
LINE = ("hpos", "width", "vpos", "height")


CASE = f"words {WORDS}, source string, tokens array<string>, gaps array<struct<start:bigint,end:bigint>>, box_hpos long, box_width long, n_chars long"


def _cases(lines: DataFrame, runs: tuple[int, ...], *carried: str) -> DataFrame:
    """Windows of every ``run`` neighbouring words (0: the whole line) with their boxes, tokens and gaps, ``run`` and the columns to
    carry; windows with overlapping words are no cases.  They are cut from Arrow batches of lines: each word of a line is taken
    once for each window that holds it."""
    rows = lines.select(*KEYS, *carried, F.col("words").cast(WORDS).alias("words"))
    others = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "words"]
    return rows.mapInArrow(window_batches(runs), ", ".join([*others, "run int", "first int", CASE]))


def merge_cases(lines: DataFrame, run: int = 2) -> DataFrame:
    """One case for every ``run`` neighbouring words."""
    return _cases(lines, (run,)).drop("run")


def line_cases(lines: DataFrame, in_line_box: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """One case for every line: all its words, in their union box or in the line's own if that holds it; other columns if ``carried``."""
    return _in_line_box(_cases(lines, (0,), *LINE, *carried), F.lit(True)).drop("run") if in_line_box else _cases(lines, (0,), *carried).drop("run")


def _in_line_box(cases: DataFrame, wanted) -> DataFrame:
    """Puts cases in the box of ``line`` where they are ``wanted`` so and it holds them."""
    line = {c: F.col(c) for c in LINE}
    holds = wanted & (line["hpos"] <= F.col("box_hpos")) & (right(line) >= F.col("box_hpos") + F.col("box_width"))
    pick = lambda name, plain: F.when(holds, line[name]).otherwise(plain)
    boxed = {"box_hpos": pick("hpos", F.col("box_hpos")), "box_width": pick("width", F.col("box_width")), "box_vpos": pick("vpos", F.lit(0)), "box_height": pick("height", F.lit(0))}
    return cases.withColumns(boxed).drop(*LINE)


def all_cases(lines: DataFrame, runs: tuple[int, ...] = (2, 3)) -> DataFrame:
    """Cases of every ``run`` neighbouring words, and whole lines in their own boxes (``run`` 0), in one pass."""
    return _in_line_box(_cases(lines, (0, *runs), *LINE), F.col("run") == 0)


def rotating(lines: DataFrame, most: int = 200, least_step: int = 4) -> DataFrame:
    """The lines of a page that a campaign corrupts, with ``at``, the first of the two neighbouring words to join: one line of
    ``least_step`` or, on long pages, as many as give about ``most`` lines, ``most`` at most; the place moves on from line to line.

    Lines without two words have nothing to join and don't count."""
    page = Window.partitionBy("corpus", "file")
    rows = lines.where(F.size("words") >= 2).withColumn("k", F.row_number().over(page.orderBy("line_ord")) - 1)
    step = F.greatest(F.lit(least_step), F.floor(F.count("*").over(page) / most))
    chosen = rows.withColumn("step", step).where((F.col("k") % F.col("step") == 0) & (F.col("k") < most * F.col("step")))
    return chosen.withColumn("at", (F.col("k") % (F.size("words") - 1)).cast("int")).drop("step")


def glued(words, at: int):
    """The words with number ``at`` and the next one made one element."""
    a, b = F.element_at(words, at + 1), F.element_at(words, at + 2)
    one = F.struct(F.concat(a["text"], b["text"]).alias("text"), a["hpos"].alias("hpos"), (right(b) - a["hpos"]).alias("width"))
    return F.when(F.size(words) > at + 1, F.concat(F.slice(words, 1, at), F.array(one), F.slice(words, at + 3, F.greatest(F.size(words) - at - 2, F.lit(0))))).otherwise(words)


def dropped(words, at):
    """The words without number ``at``."""
    return F.filter(words, lambda w, i: i != at)
