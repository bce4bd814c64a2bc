"""Arrow kernels against plain folds, and what keeps large reports from growing faster than their tables."""

from __future__ import annotations

import random
import time
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest

from pagewright.functions import arrays, kernels, rejoin
from pagewright.operators import cases, readings, resolvers, scoring, widths
from pagewright.plans import queries as plans
from pagewright.plans import readings as reading_plans

LINE = "corpus string, file long, line_ord int, hpos long, vpos long, width long, height long, words array<struct<text:string,hpos:long,width:long>>"


def _repaid(widths):
    """The fold by which missing pixels are taken from the widest, one after the other."""
    out, owed = [max(w, 1) for w in widths], sum(max(1 - w, 0) for w in widths)
    for _ in out:
        k = out.index(max(out))
        take = min(owed, out[k] - 1)
        out[k], owed = out[k] - take, owed - take
    return out


def test_widths_are_those_of_a_fold():
    rng = random.Random(5)
    tokens = [[rng.choice(["a", "bcd", " ", "\u00a0", "  ", "ééé", "\t\n", "\u2009", "\u202f "]) for _ in range(rng.randrange(0, 40))] for _ in range(300)]
    box = [rng.randrange(0, 200) for _ in tokens]
    blank = lambda t: t.isspace() and not set(t) & set("\u00a0\u202f\u2007")
    lists = pa.array(tokens, pa.list_(pa.string()))
    for rule in ("proportional", "distributed"):
        got = arrays.laid_out(lists, pa.array([7] * len(box)), pa.array(box), rule).to_pylist()
        for own, width, boxes in zip(tokens, box, got):
            whole = [len(t) * (6 if blank(t) else 10) for t in own]
            cum, prev, want = 0.0, 0, []
            for t, w in zip(own, whole):
                if rule == "proportional":
                    cum += (len(t) * 0.6 if blank(t) else float(len(t))) * (width / (sum(whole) / 10.0))
                    edge = int(np.rint(cum))
                else:
                    cum += w
                    edge = int(np.rint(width * cum / sum(whole)))
                want.append(edge - prev)
                prev = edge
            want = _repaid(want)
            assert [b["width"] for b in boxes] == want and [b["text"] for b in boxes] == own
            assert [b["hpos"] for b in boxes] == [7 + sum(want[:k]) for k in range(len(want))]


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(3)
    rows = []
    for k in range(60):
        x, words = 100, []
        for _ in range(rng.randrange(1, 12)):
            text = rng.choice(["de", "la", "é", "Straße", "république", "𝔸b"])
            wide = sum(4 + ord(c) % 13 for c in text)
            words.append((text, x, wide))
            x += wide + rng.choice([-3, 0, 6, 7])
        rows.append(("c", k % 4, k, 100, 40 * k, x - 100, 30, words))
    return spark.createDataFrame(rows, LINE)


@pytest.mark.parametrize("run", [2, 3])
def test_windows_are_neighbouring_words(lines, run, monkeypatch):
    got = {(r["line_ord"], r["first"]): r for r in cases.merge_cases(lines, run).collect()}
    want = 0
    for line in lines.collect():
        w = line["words"]
        for i in range(len(w) - run + 1):
            own = w[i : i + run]
            gaps = [(a["hpos"] + a["width"], b["hpos"]) for a, b in zip(own, own[1:])]
            assert ((line["line_ord"], i) in got) == all(b >= a for a, b in gaps)
            if (case := got.get((line["line_ord"], i))) is not None:
                want += 1
                texts = [x["text"] for x in own]
                assert [tuple(g) for g in case["gaps"]] == gaps and case["words"] == own and case["source"] == "".join(texts)
                assert case["tokens"] == " ".join(texts).replace(" ", "\0 \0").split("\0") and case["n_chars"] == len(" ".join(texts))
                assert (case["box_hpos"], case["box_hpos"] + case["box_width"]) == (own[0]["hpos"], own[-1]["hpos"] + own[-1]["width"])
    assert want == len(got) > 0


def _shuffles(frame) -> int:
    return frame._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_reports_join_no_table_with_itself(spark, tmp_path):
    docs = [(k, "\n".join("ein wort und noch " + "wort " * (k % 5) for _ in range(4)), "de", "s", 1) for k in range(20)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for query in (plans.fallback_chain, plans.ctc_report, plans.advances, reading_plans.engine_words_report, reading_plans.last_resort_report):
        assert _shuffles(query(spark, str(tmp_path))) == 0, query.__name__


def test_advances_by_line(spark):
    rows = [("f", k, "ab a", [(0, 4), (5, 9), (9, 12), (20 + k, 26 + k)]) for k in range(5)] + [("g", 0, None, None), ("g", 1, "", [])]
    cuts = spark.createDataFrame(rows, "file string, line_ord int, text string, spans array<struct<x0:long,x1:long>>")
    got = {r["glyph"]: (r["advance"], r["n"]) for r in widths.learn_advances(cuts).collect()}
    # Steps of a line: 5, 4, 11 + k and 6; their median is 5.5.
    assert got == {"a": (pytest.approx((5 / 5.5 + 6 / 5.5) / 2), 10), "b": (pytest.approx(4 / 5.5), 5), " ": (pytest.approx(13 / 5.5), 5)}


def test_one_alignment_gives_what_two_give(lines):
    rows = reading_plans.gapped(cases.line_cases(lines))
    one, two = (scoring.scored(f).orderBy("line_ord").select("line_ord", "status", "error", "boxes", "errors").collect() for f in (readings.read_boxes(rows), readings.resolve_read(readings.status_of(rows))))
    assert one == two and len(one) > 15


def test_fallback_keeps_what_there_is(lines):
    from pyspark.sql import functions as F

    rows = resolvers.resolve_distributed(cases.merge_cases(lines, 2)).withColumn("boxes", F.when(F.col("file") % 2 == 0, F.col("boxes")))
    keys = ["corpus", "file", "line_ord", "first"]
    want = resolvers.coalesced(rows, resolvers.resolve_proportional(cases.merge_cases(lines, 2)), keys)
    assert resolvers.fallen_back(rows, resolvers.resolve_proportional).select(*keys, "boxes").orderBy(*keys).collect() == want.select(*keys, "boxes").orderBy(*keys).collect()


def test_distance_is_levenshteins(spark):
    rng = random.Random(8)
    pairs = [("", ""), ("", "abc"), ("kitten", "sitting"), ("x" * 70, "x" * 70 + "y")]
    pairs += [tuple("".join(rng.choice("abé𝔸") for _ in range(rng.randrange(0, 150))) for _ in range(2)) for _ in range(200)]
    rows = spark.createDataFrame(pairs + [(None, "a")], "a string, b string").selectExpr("a", "b", "levenshtein(a, b) d").collect()
    assert [r["d"] for r in rows] == [None if r["a"] is None else kernels.distance(r["a"], r["b"]) for r in rows]


def test_long_lines_are_compared_in_time():
    text = "".join(random.Random(1).choice("abcde ") for _ in range(30_000))
    began = time.monotonic()
    assert kernels.distance(text, text.replace("e", "c")) == text.count("e")
    assert time.monotonic() - began < 20  # a table of all pairs of characters has 900 million places


def test_readings_with_holes_align_as_difflib():
    rng = random.Random(2)
    for alphabet, n in (("ab", 150), ("abcdefgh ", 400), ("aab c", 260)):
        for _ in range(12):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            for read in ("".join(c for i, c in enumerate(text) if i % 17 >= 3), "".join(c for c in text if rng.random() < 0.9), text[n // 2 :] + text[: n // 2]):
                want = [tuple(m) for m in SequenceMatcher(None, read, text, autojunk=False).get_matching_blocks() if m.size]
                assert kernels.blocks(read, text) == want
    read, text = "".join(map(chr, range(1000, 1200))), "".join(map(chr, range(2000, 2200)))
    assert kernels.blocks(read + "a" + read, text + "a" + text) == [(200, 200, 1)]  # nothing else in common on either side


def test_pages_are_put_back_one_at_a_time(spark, monkeypatch):
    """No more than a page's words are Python objects at once."""
    held = []
    lists = pa.array([["ein wort", "und noch"]] * 50), pa.array([[False, False]] * 50)
    corrected, size = pa.array([["ein", "wort", "und", "noch"]] * 50), pa.array([2] * 50)
    monkeypatch.setattr(rejoin.pa, "array", lambda x, *a, real=pa.array: held.append(len(x)) or real(x, *a))
    texts = rejoin.put_back_of.func(corrected, rejoin.linearised_of.func(*lists), size)
    assert texts.to_pylist() == lists[0].to_pylist() and max(held) == 1


def test_paired_cuts_joins_words_only(spark, tmp_path):
    docs = [(k, "ein wort und noch\neins", "de", "s", 1) for k in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    plan = reading_plans.paired_cuts(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joins = [k for k, line in enumerate(plan) if "Join " in line]
    assert joins and not any("tokens" in line or "spans" in line for line in plan[joins[0] :])
