"""Column expressions over layout data: text repair, tokens, boxes and lines.

A line is a row with ``words``, an array of structs (text, hpos, width); everything here stays in
built-in expressions and higher-order functions, so it runs in the JVM and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import word_spans_of

WORDS = "array<struct<text:string,hpos:bigint,width:bigint>>"
#: Values that :func:`chunked_fold` gathers at once.
FOLD = 64
#: White space except the three no-break spaces, which belong to words.
SPACE_TOKEN = r"(?U)^[^\S\x{A0}\x{202F}\x{2007}]+$"


def repair_mojibake(text: Column, marked: bool = True) -> Column:
    """UTF-8 that was read as Latin-1, read again; texts that don't round-trip, or if ``marked`` show no mark of it, stay as they are."""
    latin = ~text.rlike(r"[^\x{0}-\x{FF}]")
    latin = text.rlike("[ÃÂ]") & latin if marked else latin
    raw = F.when(latin, F.encode(F.when(latin, text), "ISO-8859-1"))
    return F.when(raw.isNotNull() & F.is_valid_utf8(raw), F.decode(raw, "UTF-8")).otherwise(text)


def whole_number(text: Column) -> Column:
    """A number written as text, cut toward zero; null where it isn't one."""
    return text.try_cast("double").cast("bigint")


def is_space(token: Column) -> Column:
    return token.rlike(SPACE_TOKEN)


def right(word: Column) -> Column:
    return word["hpos"] + word["width"]


def admissible(words: Column, least: int = 2) -> Column:
    """Every word is complete and wider than 0, there are enough of them, and none starts left of the one before."""
    n = F.size(words)
    bad = F.exists(words, lambda w: w["text"].isNull() | w["hpos"].isNull() | w["width"].isNull() | (w["width"] <= 0))
    pairs = F.zip_with(F.slice(words, 1, n - 1), F.slice(words, 2, n - 1), lambda a, b: b["hpos"] >= a["hpos"])
    return F.when(n >= max(least, 1), ~bad & F.forall(pairs, lambda ok: ok)).otherwise(n >= least)


def chunked_fold(values: Column, state: dict[str, Column], out: str, step) -> Column:
    """Folds an array from left to right into an array of ``out``: ``step(state, value)`` gives (new state, item).

    Items are gathered by chunks, so a long array isn't copied for each of its values."""
    n = F.size(values)
    parts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / FOLD).cast("int"))).otherwise(F.array().cast("array<int>"))
    none = F.array().cast(f"array<{out}>")
    names = list(state)

    def inner(a: Column, v: Column) -> Column:
        new, item = step({k: a[k] for k in names}, v)
        return F.struct(*[new[k].alias(k) for k in names], F.concat(a["out"], F.array(item)).alias("out"))

    def outer(a: Column, part: Column) -> Column:
        start = F.struct(*[a[k].alias(k) for k in names], none.alias("out"))
        return F.aggregate(F.slice(values, part * FOLD + 1, F.lit(FOLD)), start, inner, lambda b: F.struct(*[b[k].alias(k) for k in names], F.concat(a["out"], b["out"]).alias("out")))

    return F.aggregate(parts, F.struct(*[c.alias(k) for k, c in state.items()], none.alias("out")), outer, lambda a: a["out"])


def before_each(values: Column, start: Column) -> Column:
    """For each of the whole numbers: ``start`` and the sum of those before it."""
    return chunked_fold(values, {"x": start.cast("bigint")}, "bigint", lambda a, v: ({"x": a["x"] + v}, a["x"]))


def word_spans(words: Column, boxes: Column) -> Column:
    """A span for each character of words with one space between them, from word boxes [left, right]: even within a word, and a
    space from one box to the next.  Null where a word is empty or has no box."""
    return word_spans_of(words, boxes)


def line_box(words: Column) -> tuple[Column, Column]:
    """(hpos, width) from the first to the last word."""
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    return first["hpos"], right(last) - first["hpos"]


def characters(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda n, w: n + F.length(w["text"]))


def interleaved(words: Column) -> Column:
    """Tokens of a line: words with one space between neighbours."""
    every = F.flatten(F.transform(words, lambda w: F.array(F.lit(" "), w["text"])))
    return F.when(F.size(words) > 0, F.slice(every, 2, F.greatest(2 * F.size(words) - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))


def gaps(words: Column) -> Column:
    """Blanks between neighbouring words, (start, end)."""
    n = F.size(words)
    return F.zip_with(F.slice(words, 1, n - 1), F.slice(words, 2, n - 1), lambda a, b: F.struct(right(a).alias("start"), b["hpos"].alias("end")))


def interval_distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Distance of two intervals; 0 where they touch or overlap."""
    return F.greatest(b0 - a1, a0 - b1, F.lit(0))


def polygon_box(points: Column) -> Column:
    """The envelope of ``x,y x,y ...``; null if any point is bad or there is none."""
    xy = F.transform(F.filter(F.split(F.trim(points), r"\s+"), lambda p: p != ""), lambda p: F.struct(whole_number(F.split(p, ",")[0]).alias("x"), whole_number(F.split(p, ",")[1]).alias("y")))
    good = (F.size(xy) > 0) & F.forall(xy, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    x0, x1 = F.array_min(F.transform(xy, lambda p: p["x"])), F.array_max(F.transform(xy, lambda p: p["x"]))
    y0, y1 = F.array_min(F.transform(xy, lambda p: p["y"])), F.array_max(F.transform(xy, lambda p: p["y"]))
    return F.when(good, F.struct(x0.alias("hpos"), y0.alias("vpos"), (x1 - x0).alias("width"), (y1 - y0).alias("height")))


def vertical_overlap(a: dict, b: dict) -> Column:
    """Share of box a's height that b covers, if they share at least half of the narrower one's width; else 0."""
    hx = F.least(a["hpos"] + a["width"], b["hpos"] + b["width"]) - F.greatest(a["hpos"], b["hpos"])
    hy = F.least(a["vpos"] + a["height"], b["vpos"] + b["height"]) - F.greatest(a["vpos"], b["vpos"])
    share = F.greatest(F.lit(0.0), hy / F.greatest(F.lit(1), a["height"]))
    return F.when((hx > 0) & (hx >= 0.5 * F.least(a["width"], b["width"])), share).otherwise(F.lit(0.0))


def iou(a: dict, b: dict) -> Column:
    """Intersection over union of two boxes (x0, y0, x1, y1)."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    both = F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    return both / F.greatest(area(a) + area(b) - both, F.lit(1))


def cer_band(cer: Column) -> Column:
    return F.when(cer <= 0.05, "0-5").when(cer <= 0.15, "5-15").when(cer <= 0.30, "15-30").otherwise(">30")


def longest_run(flags: Column) -> Column:
    """Length of the longest run of true values."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(a: Column, flag: Column) -> Column:
        now = F.when(flag, a["now"] + 1).otherwise(F.lit(0))
        return F.struct(now.alias("now"), F.greatest(a["best"], now).alias("best"))

    return F.aggregate(flags, start, step, lambda a: a["best"])
