"""Reports that are worked out where lines are laid out, against the operators on frames that they stand for."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.functions import arrays
from pagewright.functions.arrays import cut_of, snapped_of, widened_of
from pagewright.operators import readings as R
from pagewright.operators import campaign, resolvers, scoring, truth, widths
from pagewright.operators.cases import line_cases
from pagewright.plans import queries, readings
from pagewright.sources import derived

DATA = "/root/testdata/sf0.001"


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def same(got, want):
    rows = lambda frame: sorted(json.dumps(r.asDict(), sort_keys=True) for r in frame.collect())
    assert rows(got) == rows(want.select(*got.columns))


def bounded(spark, frame, shuffled=("corpus", "file", "text")):
    """No line, case or character leaves its worker: what is shuffled are texts and counts, in small batches."""
    plan = plan_of(frame)
    assert "ArrowEvalPython" not in plan and "tokens" not in plan and "spans" not in plan and "words" not in plan
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4194304b"


def test_ctc_report(spark):
    keep = lambda i: (F.col("file") + i) % 17 != 0
    cases = line_cases(derived.lines(spark, DATA)).withColumn("cut", cut_of("words"))
    cases = cases.withColumn("read", F.array_join(F.filter(F.split("cut.text", ""), lambda c, i: keep(i)), "")).withColumn("spans", F.filter("cut.spans", lambda x, i: keep(i))).drop("cut")
    got = queries.ctc_report(spark, DATA)
    bounded(spark, got)
    same(got, queries.rounded(scoring.report(scoring.scored(R.read_boxes(cases)), "corpus"), *queries.REPORT))


def test_engine_words_report(spark):
    got = readings.engine_words_report(spark, DATA)
    bounded(spark, got)
    cases = readings.engine_words(line_cases(derived.lines(spark, DATA)))
    same(got, queries.rounded(scoring.report(scoring.scored(R.read_boxes(cases, missing_is_error=False)), "corpus", "status"), *queries.REPORT))


def test_last_resort_report(spark):
    got = readings.last_resort_report(spark, DATA)
    bounded(spark, got)
    k = F.col("file") + F.col("line_ord")
    cut = line_cases(derived.lines(spark, DATA)).withColumn("cut", cut_of("words"))
    read = F.when(k % 11 == 0, None).when(k % 13 == 5, F.repeat(F.lit("█"), F.length("cut.text"))).otherwise(F.col("cut.text"))
    rows = R.read_boxes(cut.withColumn("read", read).withColumn("spans", F.col("cut.spans")).drop("cut"), last_resort=True)
    same(got, rows.groupBy("corpus", "status", "error").agg(F.count("*").alias("cases"), F.count("boxes").alias("answered"), F.sum(F.element_at("boxes", 2)["hpos"]).alias("first_blank")))


def test_word_edges(spark):
    got = queries.word_edges(spark, DATA)
    bounded(spark, got)
    resolved = scoring.edge_errors(resolvers.resolve_distributed(line_cases(derived.lines(spark, DATA))))
    each = resolved.select("corpus", scoring.tiling(F.col("words"), F.col("gaps")).alias("tiling"), F.explode_outer("edges").alias("e")).where("e is not null")
    same(got, queries.rounded(each.groupBy("corpus").agg(F.count("*").alias("edges"), F.avg("e").alias("mean"), F.max("e").alias("worst"), F.count_if("tiling").alias("tiling")), "mean"))


@pytest.mark.parametrize("part", [1 / 32, 64.0])
def test_independent_truth(spark, monkeypatch, part):
    monkeypatch.setattr(truth, "PART", part)
    got = queries.independent_truth(spark, DATA)
    bounded(spark, got)
    each = queries._found(spark, DATA).select("corpus", F.explode(truth.independent_errors(F.col("found"), F.col("words"))).alias("e"))
    same(got, queries.rounded(truth.summary(each, ["corpus"]), "within", "mean", "p90"))


def test_learned_report(spark):
    got = queries.learned_report(spark, DATA)
    bounded(spark, got)
    lines = derived.lines(spark, DATA)
    same(got, queries.rounded(scoring.report(scoring.scored(widths.resolve_learned(line_cases(lines), lines)), "corpus"), *queries.REPORT))


def test_gap_width_arms(spark, tmp_path):
    """Also a file that comes twice, and one in two corpora: letter widths are those of the file, models those of the page."""
    rows = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 900").limit(12).collect()
    docs = [(r["doc_id"] // 3 * 3, r["text"] + f"\nund {k} noch eine ganze zeile\nfi fa fu", "de" if k % 2 else "en", "s", 1) for k, r in enumerate(rows)]
    docs = [(k // 2 if k < 4 else k, *d[1:]) for k, d in enumerate(docs)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = readings.gap_width_arms(spark, str(tmp_path))
    bounded(spark, got)
    lines = derived.lines(spark, str(tmp_path))
    learned = widths.learn_advances(readings.gapped(lines).withColumnRenamed("read", "text"), "file").groupBy("file")
    by_file = learned.agg(F.map_from_entries(F.collect_list(F.struct("glyph", "advance"))).alias("own"))
    models = R.relative(widths.cross_fit(lines)).select("corpus", "file", "parity", F.col("glyphs").alias("other"))
    cases = widths.in_pages(line_cases(lines)).join(by_file, "file", "left").join(models, ["corpus", "file", "parity"], "left")
    rows = R.boundary_arms(readings.gapped(cases), {"plain": F.lit(None).cast("map<string,double>"), "cut_widths": F.col("own"), "box_widths": F.col("other")}, "corpus")
    one = lambda name: R.moved(rows, "plain", name, "corpus").withColumn("arm", F.lit(name))
    same(got, queries.rounded(one("cut_widths").unionByName(one("box_widths")), "mean", "arm_mean"))


def test_whole_files(monkeypatch):
    """However batches are cut, a file's documents stay together."""
    monkeypatch.setattr(derived, "FILES_AT_ONCE", 10)
    table = pa.table({"file": [None, 1, 1, 1, 2, 3, 3, 4], "text": ["abcdef"] * 8})
    for most in (1, 2, 3, 8):
        got = [b.column("file").to_pylist() for b in derived.whole_files(table.to_batches(max_chunksize=most))]
        assert sum(got, []) == table["file"].to_pylist() and all(not set(a) & set(b) for a, b in zip(got, got[1:])) and len(got) > 2


def test_ink_snap_report(spark):
    got = queries.ink_snap_report(spark, DATA)
    bounded(spark, got)
    same(got, queries.rounded(scoring.report(scoring.scored(queries._with_gaps(spark, DATA).withColumn("boxes", widened_of("boxes", "some", "box_hpos", "box_width"))), "corpus"), *queries.REPORT))


def by_lines(spark, data):
    """What paired_cuts and paired_gaps give, with lines joined."""
    pairs, lines = readings.cache_pairs(spark, data, "cuts")[0], derived.lines(spark, data).select(*queries.KEYS, "words")
    entries = lines.where("line_ord % 6 <> 4").select(F.concat(F.lit("cuts-"), F.col("file").cast("string")).alias("cache"), "line_ord", F.col("words").alias("own"))
    joined = line_cases(campaign.with_cache(lines, pairs, entries), carried=("pair", "own")).withColumn("cut", F.when(F.col("own").isNotNull(), cut_of("own")))
    answered = scoring.scored(R.read_boxes(joined.withColumn("read", F.col("cut.text")).withColumn("spans", F.col("cut.spans")).drop("cut", "own")))
    error = F.when(campaign.usable("pair"), F.col("error")).otherwise(F.col("pair"))
    cuts = answered.groupBy("corpus", "pair", error.alias("error")).agg(F.count("*").alias("cases"), F.countDistinct("file").alias("files"), F.sum(F.size("errors")).alias("boundaries"))
    pairs, names = readings.cache_pairs(spark, data, "gaps")
    entries = line_cases(derived.lines(spark, data)).where("line_ord % 6 <> 4").join(names, "file").select("cache", "line_ord", F.col("gaps").alias("blanks"))
    cases = campaign.with_cache(resolvers.resolve_proportional(line_cases(derived.lines(spark, data))), pairs, entries).repartition(*queries.KEYS)
    rows = cases.withColumn("snapped", snapped_of("boxes", F.coalesce("blanks", F.array().cast("array<struct<start:bigint,end:bigint>>")), "box_hpos", "box_width"))
    return cuts, rows.groupBy("corpus", "pair").agg(F.count("*").alias("cases"), F.count("blanks").alias("with_gaps"), F.count_if(F.col("snapped") != F.col("boxes")).alias("moved"))


def test_pairs_join_texts(spark, tmp_path):
    """Also files that come twice, in one corpus and in two, and texts that are null."""
    docs = [(k, f"ein wort und {k} noch\neins\nzwei drei\n\nvier fünf\nsechs sieben\nacht neun", "de", "s", 1) for k in range(60)]
    docs += [(7, "noch ein text", "de", "s", 1), (22, "noch ein text", "en", "s", 1), (61, None, "de", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    cuts, gaps = by_lines(spark, str(tmp_path))
    for got, want in ((readings.paired_cuts(spark, str(tmp_path)), cuts), (readings.paired_gaps(spark, str(tmp_path)), gaps)):
        assert "words" not in plan_of(got) and "gaps:" not in plan_of(got)
        same(got, want)


def test_lines_of_another_cache():
    """A line's entry is the line of its number in the text that its cache was made of."""
    rows = [("de", 5, "a b\nc d\ne f", "checked", True, None), ("de", 6, "g h\ni\nj k\nl m", "checked", False, "n o p\nq r\n\ns t"), ("de", 7, "u v", "no pair", False, None)]
    names = ["corpus", "file", "text", "pair", "held", "cached"]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "cached" else None) for n, c in zip(names, zip(*rows))], names)
    got = [(r["file"], r["line_ord"], None if r["own"] is None else " ".join(w["text"] for w in r["own"])) for lines in derived._paired_lines(batch) for r in lines.to_pylist()]
    assert got == [(5, 0, "a b"), (5, 1, "c d"), (5, 2, "e f"), (6, 0, "n o p"), (6, 2, None), (6, 3, "s t"), (7, 0, None)]


def test_a_line_longer_than_the_table_of_blanks(monkeypatch):
    monkeypatch.setattr(arrays, "CELLS", 20)
    n = np.arange(9)
    edges = [[{"start": int(20 * k + 12), "end": int(20 * k + 18)} for k in n]]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    boxes = [[{"text": "word" if k % 2 == 0 else " ", "hpos": 10 * k, "width": 10} for k in range(19)]]
    got = arrays.snapped_of.func(pa.array(boxes), pa.array(edges, kind), pa.array([0]), pa.array([190])).to_pylist()[0]
    assert [(b["hpos"], b["hpos"] + b["width"]) for b in got if b["text"] == " "] == [(20 * k + 12, 20 * k + 18) for k in n]
