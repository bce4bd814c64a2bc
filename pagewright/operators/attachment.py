"""Whether a returned text sits on its own line: each line's best *other* line of its page, margins and twins.

A page's lines aren't paired.  Only lines whose text is unlike their own are looked up, and a line that is looked up meets its
page's lines in blocks of ``BLOCK`` ordinals by ``BLOCK``: a task holds two blocks, whatever the page's length, and upper bounds
(:mod:`pagewright.functions.likeness`) leave few pairs to compare exactly.  How like its own line a changed line is decides what is
looked up and is asked for again and again, so it is worked out once, and staged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.likeness import Texts, best_of_each, likeness_of

#: Ordinals of a page's lines that one side of a task's group holds.
BLOCK = 512
#: Lines looked up, more or less, in a task's group.
TOGETHER = 512
MARGIN, TWIN, LEAST = 0.15, 0.85, 0.35
#: Floors are compared with rounded fractions; decisions are made on the exact values afterwards.
_SLACK = 1e-9


def _tasks(frame: DataFrame) -> int:
    return 4 * frame.sparkSession.sparkContext.defaultParallelism


def valued(lines: DataFrame, a: str, b: str) -> DataFrame:
    """Changed lines (page, ord, output, a, b) with the likeness of their columns a and b as ``own``, staged.

    Lines are dealt out to several tasks for each core: by its bytes the work would seem to need only a few."""
    from ..llm.common import stage  # the subpackage may be absent

    changed = lines.where(~F.col("output").eqNullSafe(F.col("source"))).select("page", "ord", *dict.fromkeys([a, b, "output"]))
    return stage(changed.repartition(_tasks(lines), "page", "ord", "output").withColumn("own", likeness_of(a, b)), "valued")


def best_other(queries: DataFrame, lines: DataFrame, twin: float | None = None) -> DataFrame:
    """(page, ord, score, other): for each query (page, ord, text, floor, own_text) the other line (page, ord, text) of its page
    that is most like it, of equal ones the last; only where the floor is reached.

    With ``twin``, lines so like the query's ``own_text`` are passed over.  Rows without a page or ord have no page to be
    searched; null texts are empty."""
    block = lambda c: F.floor(F.col(c) / BLOCK).cast("long")
    # Small pages are looked at together: a task's group holds the pages of a bucket, a long page's blocks of ordinals lie apart.
    bucket = F.pmod(F.xxhash64("page"), F.lit(max(1, queries.count() // TOGETHER))).alias("bucket")
    whole = lines.where("page is not null and ord is not null").select("page", bucket, block("ord").alias("there"), F.col("ord").alias("id"), F.coalesce("text", F.lit("")).alias("body"))
    asked = queries.where("page is not null and ord is not null").select("page", bucket, block("ord").alias("here"), "ord", F.coalesce("text", F.lit("")).alias("text"), "floor", F.coalesce("own_text", F.lit("")).alias("own_text"))
    spread = asked.join(whole.select("page", "there").distinct(), "page")
    met = whole.join(asked.select("page", "here").distinct(), "page")
    met = met.select("page", "bucket", "here", "there", "id", "body")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            right = right.sort_by([("page", "ascending"), ("id", "ascending")])
            pages, ids, bodies = right.column("page").to_numpy(), right.column("id").to_pylist(), right.column("body").to_pylist()
            among = Texts(bodies)
            page, ord_, text, floor, own_text = (left.column(c).to_pylist() for c in ("page", "ord", "text", "floor", "own_text"))
            ranges = list(zip(*(np.searchsorted(pages, page, side).tolist() for side in ("left", "right"))))
            got = best_of_each(text, among, bodies, ids, ord_, [f - _SLACK for f in floor], own_text, twin, ranges)
            out += [(p, o, *x) for p, o, x in zip(page, ord_, got) if x is not None]
        columns = list(zip(*out)) or [[], [], [], []]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("page", "ord", "score", "other"), columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))})

    keys = ["bucket", "here", "there"]
    spread = spread.select(*[F.col(c).alias(c) for c in spread.columns])  # both sides come from one frame: columns of their own
    tasks = _tasks(lines)  # comparing takes long for its bytes: none are joined
    spread, met = spread.repartition(tasks, *keys), met.repartition(tasks, *keys)
    found = spread.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(run, "page long, ord long, score double, other long")
    best = found.groupBy("page", "ord").agg(F.max(F.struct("score", "other")).alias("best"))
    return best.select("page", "ord", "best.score", "best.other")


def misattached(lines: DataFrame, margin: float = MARGIN, twin: float = TWIN) -> DataFrame:
    """(page, ord, own, other, score, wrong) of changed lines (page, ord, source, output, truth) that another line's truth
    fits better than their own by more than the margin; ``wrong`` unless that other truth is their own one's twin."""
    asked = valued(lines, "truth", "output").where(F.col("own") + margin <= 1)
    queries = asked.select("page", "ord", F.col("output").alias("text"), (F.col("own") + margin).alias("floor"), F.col("truth").alias("own_text"))
    best = best_other(queries, lines.select("page", "ord", F.col("truth").alias("text"))).where("score is not null")
    truths = lines.select("page", F.col("ord").alias("other"), F.col("truth").alias("other_truth"))
    pairs = asked.select("page", "ord", "own", "truth").join(best, ["page", "ord"]).where(F.col("score") > F.col("own") + margin).join(truths, ["page", "other"])
    return pairs.repartition(_tasks(lines), "page", "ord").select("page", "ord", "own", "other", "score", (likeness_of("truth", "other_truth") < twin).alias("wrong"))


def margin_veto(lines: DataFrame, least: float = LEAST, margin: float = MARGIN, twin: float | None = TWIN, changed: DataFrame | None = None) -> DataFrame:
    """(page, ord, own, other, score, verdict) for every changed line (page, ord, source, output).

    A change is accepted if it is ``least`` like its own source or more, and by more than the margin more like it than like
    any other source of the page; with ``twin``, sources so like its own don't count.  Verdicts: ``accepted``, ``unlike``,
    ``nearer elsewhere``.  ``changed`` are the lines that :func:`valued` gives for source and output, if they are there."""
    changed = valued(lines, "source", "output") if changed is None else changed
    asked = changed.where(F.col("own") >= least).select("page", "ord", F.col("output").alias("text"), (F.col("own") - margin).alias("floor"), F.col("source").alias("own_text"))
    best = best_other(asked, lines.select("page", "ord", F.col("source").alias("text")), twin)
    verdict: Column = F.when(F.col("own") < least, "unlike").when(F.col("own") > F.coalesce(F.col("score"), F.lit(-1.0)) + margin, "accepted").otherwise("nearer elsewhere")
    return changed.select("page", "ord", "own").join(best, ["page", "ord"], "left").select("page", "ord", "own", "other", "score", verdict.alias("verdict"))
