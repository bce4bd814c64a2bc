"""Readings of lines: word boxes, statuses, letter widths in gaps, paired caches, derived lines, bands and inversions."""

import random

import pytest
from pyspark.sql import functions as F

from pagewright.functions.columns import word_spans
from pagewright.functions.kernels import transfer
from pagewright.operators import campaign, matching, readings
from pagewright.sources import derived

DATA = "/root/testdata/sf0.001"


def test_word_spans(spark):
    """Even within a word, half to even; a word without letters or without a box leaves the line out, boxes to spare don't."""
    rows = [("ab c", [[0, 10], [20, 24]]), ("abcd", [[0, 10]]), ("a  b", [[0, 1], [2, 3], [4, 5]]), ("a b", [[0, 5]]), ("a", [[0, 5], [7, 9]])]
    frame = spark.createDataFrame(rows, "text string, boxes array<array<bigint>>")
    got = [None if r["s"] is None else [tuple(x) for x in r["s"]] for r in frame.select(word_spans(F.split("text", " "), F.col("boxes")).alias("s")).collect()]
    assert got == [[(0, 5), (5, 10), (10, 20), (20, 24)], [(0, 2), (2, 5), (5, 8), (8, 10)], None, None, [(0, 5)]]


@pytest.fixture(scope="module")
def cases(spark):
    """One word, a space and another word each; read well, weakly, and not at all."""
    tokens = ["mill", " ", "pond"]
    rows = [("c", 1, k, tokens, 100, 90, 9, [(140, 150)], read) for k, read in enumerate(["mill pond", "qqqq", None])]
    frame = spark.createDataFrame(rows, "corpus string, file long, line_ord int, tokens array<string>, box_hpos bigint, box_width bigint, n_chars int, gaps array<struct<start:bigint,end:bigint>>, read string")
    spans = F.transform(F.sequence(F.lit(0), F.length("read") - 1), lambda k: F.struct((100 + 10 * k).cast("bigint").alias("x0"), (110 + 10 * k).cast("bigint").alias("x1")))
    return readings.status_of(frame.withColumn("spans", F.when(F.col("read").isNotNull(), spans)))


def test_weak_and_missing_readings(cases):
    assert [r["status"] for r in cases.orderBy("line_ord").collect()] == ["read", "weak", "missing"]

    def got(**rules):
        return [(r["error"], None if r["boxes"] is None else r["boxes"][1]["hpos"]) for r in readings.resolve_read(cases, **rules).orderBy("line_ord").collect()]

    base = 100 + round(90 * 4 / 8.6)
    assert got() == [(None, 140), (None, base), ("missing line", None)]
    assert got(missing_is_error=False) == [(None, 140), (None, base), (None, base)]
    assert got(last_resort=True) == [(None, 140), ("low support", None), ("missing line", None)]


def test_letter_widths_move_what_was_not_read(spark, cases):
    """Of a line whose middle wasn't read, wide letters get more room; what was read stays."""
    span = lambda a, b: F.struct(F.lit(a).cast("bigint").alias("x0"), F.lit(b).cast("bigint").alias("x1"))
    read, spans, tokens = "mpond", [(100, 110), (150, 160), (160, 170), (170, 180), (180, 190)], ["mill", " ", "pond"]
    narrow = F.array(F.struct(F.lit(140).cast("bigint").alias("start"), F.lit(143).cast("bigint").alias("end")))
    rows = readings.status_of(cases.where("line_ord = 0").withColumns({"read": F.lit(read), "spans": F.array(*[span(*x) for x in spans]), "gaps": narrow}))
    wide = F.create_map(*[F.lit(x) for pair in {"l": 3.0, "i": 1.0, " ": 0.5, "p": 1.0}.items() for x in pair])
    each = readings.boundary_arms(rows, {"plain": F.lit(None).cast("map<string,double>"), "wide": wide}, "corpus").collect()
    for arm, widths in (("plain", None), ("wide", {"l": 3.0, "i": 1.0, " ": 0.5, "p": 1.0})):
        _, x, w = transfer(read, spans, tokens, 100, 90, widths)[0][1]
        assert [r[arm] for r in each] == [max(140 - (x + w / 2), x + w / 2 - 143, 0)]
    total = readings.moved(spark.createDataFrame(each), "plain", "wide", "corpus").first()
    assert (total["moved"], total["boundaries"]) == (int(each[0]["plain"] != each[0]["wide"]), 1) and total["moved"] == 1


def test_relative_widths(spark):
    models = spark.createDataFrame([({"a": 2.0, "b": 4.0, "c": 8.0, "d": 6.0}, 3.0, 5.0), ({}, 0.6, 2.0), ({"a": 0.0}, 1.0, 0.0)], "glyphs map<string,double>, space double, unit double")
    assert [r["glyphs"] for r in readings.relative(models).collect()] == [{"a": 1 / 3, "b": 4 / 6, "c": 8 / 6, "d": 1.0, " ": 0.5}, {" ": 0.3}, {"a": 0.0, " ": 1.0}]


def test_paired_caches(spark):
    """Swapped, repeated, shared and silent caches are refused with their reason, and no request is multiplied."""
    frame = spark.createDataFrame
    manifest = frame([("c", 1, "k1"), ("c", 2, "k1"), ("c", 3, "k3"), ("c", 4, "k4"), ("c", 4, "k5"), ("c", 6, "k6"), ("c", 7, "k7"), ("c", 8, "k8"), ("c", 9, "k9"), ("c", 10, "k10"), ("c", 12, None)], "corpus string, file long, cache string")
    caches = frame([("k1", "d1", None), ("k3", "other", None), ("k4", "d4", None), ("k5", "d4", None), ("k6", None, None), ("k7", "d7", "wrong"), ("k8", "d8", "i8"), ("k8", "d8", "i8"), ("k9", "d9", "i9")], "cache string, layout_digest string, image_digest string")
    sources = frame([(k, f"d{k}", f"i{k}" if k > 6 else None) for k in (1, 2, 3, 4, 6, 7, 8, 9, 10, 12)], "file long, layout_digest string, image_digest string")
    status = lambda **r: {x["file"]: x["status"] for x in campaign.paired(manifest, caches, sources, **r).collect()}
    want = {1: "shared cache", 2: "shared cache", 3: "layout differs", 4: "repeated file", 6: "no provenance", 7: "image differs", 8: "repeated cache", 9: "checked", 10: "missing cache", 12: "missing cache"}
    assert status() == want and status(require_provenance=False) == want | {6: "unchecked"}
    requests = frame([("c", k, n) for k in (3, 6, 8, 9, 11) for n in (0, 1)], "corpus string, file long, line_ord int")
    entries = frame([(f"k{k}", 0, f"text {k}") for k in (3, 6, 8, 8, 9)], "cache string, line_ord int, read string")
    rows = campaign.with_cache(requests, campaign.paired(manifest, caches, sources, False), entries).collect()
    assert len(rows) == 10
    assert {(r["file"], r["line_ord"], r["pair"], r["read"]) for r in rows if r["line_ord"] == 0} == {(3, 0, "layout differs", None), (6, 0, "unchecked", "text 6"), (8, 0, "repeated cache", None), (9, 0, "checked", "text 9"), (11, 0, "no pair", None)}


def test_derived_lines(spark, tmp_path):
    """Lines laid out from running sums are those laid out word by word, long, empty and null texts among them."""
    r = random.Random(12)
    texts = ["", None, "one", "\n\n a  b \n", "é€😀x y\n z", " ".join(["long"] * 9000), *["".join(r.choice(["ab", " ", "\n", "ß", "日", "  "]) for _ in range(r.randint(0, 60))) for _ in range(60)]]
    spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for k, text in enumerate(texts):
        for n, line in enumerate((text or "").split("\n")):
            x, boxes = 100, []
            for j, word in enumerate(w for w in line.split(" ") if w):
                width = sum(4 + ord(c) % 13 for c in word)
                boxes.append((word, x, width))
                x += width + 6 + j % 3
            if boxes:
                want[k, n] = boxes
    for size in (derived.SLICE, 7):
        derived.SLICE, old = size, derived.SLICE
        got = {(x["file"], x["line_ord"]): [tuple(w) for w in x["words"]] for x in derived.all_lines(spark, str(tmp_path)).collect()}
        derived.SLICE = old
        assert got == want
    line = derived.lines(spark, str(tmp_path)).where("file = 4 and line_ord = 0").first()
    assert (line["hpos"], line["vpos"], line["width"], line["height"]) == (100, 0, sum(w[2] for w in line["words"]) + 6, 30)


def test_tall_boxes_meet_what_they_reach(spark):
    r = random.Random(13)
    boxes = [(k % 3, k, r.randint(0, 300), y, 0, y + r.choice([0, 5, 30, 64, 70, 500, 4000])) for k in range(150) for y in [r.randint(-50, 5000)]]
    boxes = [(f, k, x, y, x + r.randint(1, 200), y1) for f, k, x, y, _, y1 in boxes]
    frame = spark.createDataFrame(boxes, "file long, id long, x0 long, y0 long, x1 long, y1 long")
    met = [(x["file"], x["a_id"], x["b_id"]) for x in matching.meeting(frame, frame.select(*[F.col(c).alias(c) for c in frame.columns])).collect()]
    assert len(met) == len(set(met))
    touching = {(a[0], a[1], b[1]) for a in boxes for b in boxes if a[0] == b[0] and a[3] <= b[5] and b[3] <= a[5]}
    assert touching <= set(met)
    assert matching.meeting(frame.where("false"), frame).count() == 0


def test_inversions(spark):
    r = random.Random(14)
    rows = [(g, k, r.randint(0, 40)) for g in range(4) for k in range([0, 1, 30, 200][g])]
    got = {x["g"]: x["inversions"] for x in matching.inversions(spark.createDataFrame(rows, "g long, k long, v long"), "g", "k", "v").collect()}
    by = {g: [v for h, _, v in rows if h == g] for g in range(1, 4)}
    assert got == {g: sum(a > b for i, a in enumerate(vs) for b in vs[i + 1 :]) for g, vs in by.items()}


def test_pages_as_a_stream(spark, tmp_path):
    """Files that arrive are triaged as in one batch, and a stream that goes on doesn't do them again."""
    from pagewright.operators.triage import triage
    from pagewright.streaming.pages import triage_stream

    boxes = derived.boxes(spark, DATA)
    for part in (0, 1):
        boxes.where(f"file % 2 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        arriving = spark.readStream.schema(boxes.schema).parquet(f"{tmp_path}/in")
        triage_stream(arriving, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert {r["batch"] for r in got.select("batch").distinct().collect()} == {0, 1}
    want = triage(boxes)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_snapping_of_many_lines_is_that_of_each():
    """Random lines, of words and blanks in any order, against the kernels of one line."""
    import random

    import pyarrow as pa

    from pagewright.functions import arrays, kernels

    r = random.Random(11)
    rows = []
    for _ in range(400):
        x, boxes = r.randint(0, 9), []
        for _ in range(r.choice([0, 1, 3, 9, 40])):
            w = r.randint(1, 14)
            boxes.append((r.choice(["ab", "c", "defgh", " ", " ", "\x1c", " "]), x, w))
            x += w + r.choice([0, 0, 2])
        gaps = sorted((a, a + r.randint(0, 9)) for a in (r.randint(0, x + 5) for _ in range(r.choice([0, 1, 5, 45]))))
        r.random() < 0.2 and r.shuffle(gaps)
        rows.append((boxes, gaps, r.randint(0, 9), x))
    # Words with one blank between them, some blanks found a little off.
    for n in (2, 5, 17, 60):
        boxes = [("word" if i % 2 == 0 else " ", 10 + 20 * i, 20) for i in range(2 * n - 1)]
        rows.append((boxes, [(x + r.randint(-6, 6), x + 20) for t, x, _ in boxes if t == " " for _ in range(2) if r.random() < 0.95], 10, 20 * (2 * n - 1)))
    box, gap = pa.list_(pa.struct([("text", pa.string()), ("hpos", pa.int64()), ("width", pa.int64())])), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    named = lambda values, names: [dict(zip(names, v)) for v in values]
    columns = [pa.array([named(x[0], ("text", "hpos", "width")) for x in rows], box), pa.array([named(x[1], ("start", "end")) for x in rows], gap), *(pa.array([x[k] for x in rows], pa.int64()) for k in (2, 3))]
    for many, one in ((arrays.snapped_of, kernels.snapped_to_gaps), (arrays.widened_of, kernels.widened_to_ink)):
        got = [[tuple(b.values()) for b in own] for own in many.func(*columns).to_pylist()]
        want = [one(*row) for row in rows]
        assert got == want and sum(a != row[0] for a, row in zip(want, rows)) > 20
