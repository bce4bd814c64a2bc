"""Attachment, guards and reprojection against all pairs and brute force."""

import random
import re
from difflib import SequenceMatcher

import numpy as np
import pytest

from pyspark.sql import functions as F

from pagewright.functions import likeness as L
from pagewright.functions import rejoin
from pagewright.operators import attachment, guards, reprojection


def ratio(a, b):
    return SequenceMatcher(None, a.casefold(), b.casefold(), autojunk=False).ratio()


def some_text(r, n):
    return " ".join("".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6))) for _ in range(n))


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def test_common_subsequence():
    r = random.Random(5)
    for _ in range(40):
        one, others = some_text(r, r.randint(1, 40)), [some_text(r, r.randint(0, 50)) for _ in range(4)] + ["", "zzz"]
        among = L.Texts(others)
        got = L.common_subsequence(among.numbers(one.casefold()), among.matrix(np.arange(6)), len(among.letters))
        assert got.tolist() == [subsequence(one.casefold(), x.casefold()) for x in others]


def test_best_of_is_the_best_of_all():
    r = random.Random(6)
    for floor in (0.0, 0.3, 0.6, 0.9):
        for _ in range(25):
            others = [some_text(r, r.randint(0, 9)) for _ in range(12)]
            one = r.choice([*others, some_text(r, 5), ""])
            own = r.randrange(13)
            want = max(((ratio(x, one), i) for i, x in enumerate(others) if i != own), default=None)
            got = L.best_of(one, L.Texts(others), list(range(12)), own, floor)
            assert got == (want if want and want[0] >= floor else None)


@pytest.fixture(scope="module")
def page_lines(spark):
    """Swapped, twin, near and unlike lines on pages of one to forty lines, empty and null texts, and a clashing column."""
    r, rows = random.Random(7), []
    for page in range(14):
        truth = [some_text(r, r.randint(1, 12)) for _ in range([1, 7, 40][page % 3])]
        truth = [truth[k - 1] + " xyxyxyx" if k % 6 == 5 else t for k, t in enumerate(truth)]
        for k, t in enumerate(truth):
            source = t.replace("e", "c")
            output = r.choice([t, t, source, truth[(k + 1) % len(truth)], truth[(k - 1) % len(truth)][:30], "xyxyxyx", "xyxyxyx", some_text(r, 6), "", None])
            rows.append((page, k, source, output, t, 1))
    return spark.createDataFrame(rows, "page long, ord long, source string, output string, truth string, here int")


@pytest.mark.parametrize("block", [512, 5])
def test_misattached(page_lines, monkeypatch, block):
    monkeypatch.setattr(attachment, "BLOCK", block)
    rows, want = page_lines.collect(), set()
    for x in rows:
        if x["output"] != x["source"]:
            out, own = x["output"] or "", ratio(x["truth"], x["output"] or "")
            best = max(((ratio(y["truth"], out), y["ord"], y["truth"]) for y in rows if y["page"] == x["page"] and y["ord"] != x["ord"]), default=(0, None))
            if best[1] is not None and best[0] > own + 0.15:
                want.add((x["page"], x["ord"], own, best[1], best[0], ratio(x["truth"], best[2]) < 0.85))
    assert {tuple(r) for r in attachment.misattached(page_lines).collect()} == want and len(want) > 20 and any(not w[-1] for w in want)
    assert attachment.misattached(page_lines.where("false")).count() == 0


@pytest.mark.parametrize("block, twin", [(512, 0.85), (5, 0.85), (5, None)])
def test_margin_veto(page_lines, monkeypatch, block, twin):
    monkeypatch.setattr(attachment, "BLOCK", block)
    rows, want = page_lines.collect(), set()
    for x in rows:
        if x["output"] != x["source"]:
            out, own = x["output"] or "", ratio(x["source"], x["output"] or "")
            others = [ratio(y["source"], out) for y in rows if y["page"] == x["page"] and y["ord"] != x["ord"] and not (twin and ratio(x["source"], y["source"]) >= twin)]
            want.add((x["page"], x["ord"], "unlike" if own < 0.35 else "accepted" if own > max(others, default=-1) + 0.15 else "nearer elsewhere"))
    got = attachment.margin_veto(page_lines, twin=twin).select("page", "ord", "verdict").collect()
    assert {tuple(r) for r in got} == want and {w[2] for w in want} == {"unlike", "accepted", "nearer elsewhere"} and len(got) == len(want)


def brute_page(lines, marks):
    """The stream of words by a walk over characters: (word, first line, tail line, head, mark)."""
    out, wait = [], None
    for i, text in enumerate(lines):
        if wait:
            k = text.find(" ")
            tail, text = (text, "") if k < 0 else (text[:k], text[k + 1 :])
            out.append((wait[0] + tail, wait[1], i, wait[0], wait[2]))
            wait = None
        own = text.split()
        if own and i < len(lines) - 1 and (marks[i] or text.rstrip()[-1:] in tuple(rejoin.HYPHENS)):
            bare = own[-1].rstrip(rejoin.HYPHENS)
            wait = (bare, i, own[-1][len(bare) :])
            own = own[:-1]
        out += [(w, i, None, None, None) for w in own]
    return out


def brute_put_back(corrected, owners, n):
    lines = [[] for _ in range(n)]
    for tag, i1, i2, j1, j2 in SequenceMatcher(None, [o[0] for o in owners], corrected, autojunk=False).get_opcodes():
        for k in range(j2 - j1):
            word, owner = corrected[j1 + k], owners[min(i1 + k, max(i1, i2 - 1), len(owners) - 1)]
            if owner[2] is None:
                lines[owner[1]].append(word)
                continue
            head, cut = owner[3], min(len(owner[3]), len(word))
            for _, a1, a2, b1, b2 in SequenceMatcher(None, owner[0], word, autojunk=False).get_opcodes():
                if a1 <= len(head) <= a2:
                    cut = b1 + min(len(head) - a1, b2 - b1)
                    break
            for part, to in ((word[:cut] + owner[4], owner[1]), (word[cut:], owner[2])):
                if part:
                    lines[to].append(part)
    return [" ".join(x) for x in lines]


def test_words_are_put_back_as_a_fold_does():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 5)))
    for _ in range(300):
        lines = [r.choice(["", " ", "x-", "- ", r.choice(["", " "]) + " ".join(word() for _ in range(r.randint(1, 6))) + r.choice(["", "", "-", "¬", "--", " -", "­ "])]) for _ in range(r.randint(1, 7))]
        marks = [r.random() < 0.3 for _ in lines]
        owners = rejoin.linearised(lines, marks)
        want = brute_page(lines, marks)
        assert [(*o[:3], o[0][: o[3]], o[4]) if o[2] >= 0 else (*o[:2], None, None, None) for o in owners] == want
        if not owners:
            assert rejoin.put_back(["a"], owners, len(lines)) == [""] * len(lines)
            continue
        same = rejoin.put_back([o[0] for o in owners], owners, len(lines))
        assert same == brute_put_back([o[0] for o in owners], want, len(lines))
        changed = [w for o in owners for w in r.choice([[o[0]], [o[0]], [], [o[0], word()], [o[0][:2] + word()], ["new", o[0]]])]
        assert rejoin.put_back(changed, owners, len(lines)) == brute_put_back(changed, want, len(lines))


def test_hyphens_come_back(spark):
    """A visible hyphen is text and comes back, a mark beside the text isn't; corrections keep the cut where it was."""
    lines = spark.createDataFrame([(1, 0, "the be-", False, 0), (1, 1, "ginning of inter", True, 0), (1, 2, "national", False, 0), (1, 3, None, None, 0), (2, 0, "alone-", True, 0), (3, 5, "", False, 0)], "page long, ord long, text string, hyphened boolean, word int")
    pages = reprojection.linearise(lines)
    whole = {r["page"]: [o["word"] for o in r["owners"]] for r in pages.collect()}
    assert whole == {1: ["the", "beginning", "of", "international"], 2: ["alone-"], 3: []}
    texts = lambda words: {(r["page"], r["ord"]): r["text"] for r in reprojection.put_back(pages.withColumn("corrected", words)).collect()}
    assert texts(F.col("owners.word")) == {(1, 0): "the be-", (1, 1): "ginning of inter", (1, 2): "national", (1, 3): "", (2, 0): "alone-", (3, 5): ""}
    better = texts(F.transform("owners.word", lambda w: F.replace(F.replace(w, F.lit("begin"), F.lit("bEEgin")), F.lit("natio"), F.lit("NATIO"))))
    assert [better[1, k] for k in range(4)] == ["the bE-", "Eginning of inter", "NATIOnal", ""]
    assert reprojection.put_back(reprojection.linearise(lines.where("false")).withColumn("corrected", F.array(F.lit("x")))).count() == 0


def longest(flags):
    return max((len(run) for run in "".join("x" if f else " " for f in flags).split()), default=0)


def brute_anchored(reference, output):
    a, b, hit = reference.casefold(), output.casefold(), set()
    for block in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
        if block.size >= 3:
            hit |= set(range(block.b, block.b + block.size))
    return [2 * len(hit & set(range(m.start(), m.end()))) >= m.end() - m.start() for m in re.finditer(r"[^\W\d_]+", b) if m.end() - m.start() > 2]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_guards(spark):
    """All thresholds against one pass each over plain rows; the last row of a correction stands for it."""
    r, rows = random.Random(9), []
    for k in range(60):
        truth = " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(8))
        source = truth.translate(str.maketrans("ae", "oc"))
        outputs = [truth, source, truth[:10] + " klmno pqrst uvwxy zklmn opqrs"[: r.choice([6, 18, 30])] + truth[10:], "klmno pqrst uvwxy " + truth[20:]]
        rows += [(r.choice(["one", "two"]) if k % 2 else "one", p, t, k // 2, k % 2, source, r.choice(outputs), truth, 0) for t, p in enumerate(["x", "y", "z"])]
    frame = spark.createDataFrame(rows, "corpus string, producer string, turn int, page long, ord long, source string, output string, truth string, run int")
    want = set()
    for corpus in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == corpus]
        changed = [(*x, distance(x[5], x[7]), distance(x[6], x[7])) for x in own if x[6] != x[5]]
        last = {(x[3], x[4], x[6]): x for x in sorted(changed, key=lambda x: x[2])}
        runs = {key: longest(not f for f in brute_anchored(x[5], x[6])) for key, x in last.items()}
        made = {key: longest(not f and not g for f, g in zip(brute_anchored(x[5], x[6]), brute_anchored(x[7], x[6]))) for key, x in last.items()}
        letters, errors = sum(len(x[7]) for x in own), sum(distance(x[6], x[7]) for x in own)
        for limit in (2, 3, 4):
            hit = [x for x in changed if runs[x[3], x[4], x[6]] > limit]
            keys = {(x[3], x[4], x[6]) for x in hit}
            saved = sum(x[9] - x[10] for x in hit)
            want.add((
                corpus, len(changed), sum(x[10] < x[9] for x in changed), len(last), sum(m >= 3 for m in made.values()), limit, len(hit), len(keys),
                sum(made[key] >= 3 for key in keys), sum(last[key][10] < last[key][9] for key in keys), round(errors / letters, 9), round((errors + saved) / letters, 9),
            ))
    got = guards.guard_report(frame).select("corpus", "changed", "better", "corrections", "faulty", "limit", "stopped_rows", "stopped", "stopped_faulty", "stopped_good", F.round("cer", 9), F.round("cer_reverted", 9))
    assert {tuple(x) for x in got.collect()} == want and any(w[6] for w in want) and any(w[8] < w[7] for w in want)
    assert guards.guard_report(frame.where("false")).count() == 0


def test_unanchored_share_is_that_of_all_pairs():
    r = random.Random(10)
    for _ in range(120):
        source, output = ("".join(r.choice([*"aAbcdEéf", " ", ",", "1", "_"]) for _ in range(r.randint(0, 60))) for _ in range(2))
        output = output + " " + source[5:20] if r.random() < 0.5 else output
        sw, ow = ([w for w in re.findall(r"[^\W\d_]+", t.lower()) if len(w) >= 3] for t in (source, output))
        bad = [w for w in ow if w not in source.lower() and not any(SequenceMatcher(None, w, x, autojunk=False).ratio() >= 0.5 for x in sw)]
        assert L.unanchored_share(source, output) == (len(bad) / len(ow) if ow else 0.0)


def test_recourse(spark):
    rows = [(1, 0, "abcdefghij", "unlike"), (1, 1, "abcdefghij", "unlike"), (1, 2, "abcdefghij", "unlike"), (1, 3, "abcdefghij", "like"), (1, 4, "", "unlike"), (1, 5, "abcdefghij", "unlike")]
    vetoed = spark.createDataFrame(rows, "page long, ord long, output string, verdict string")
    readings = spark.createDataFrame([(1, 0, "abcdefxyzq"), (1, 1, "abcdezzzzz"), (1, 3, "abcdefghij"), (1, 4, ""), (1, 5, None)], "page long, ord long, read string")
    got = {r["ord"]: (r["recourse"], r["support"]) for r in guards.recourse(vetoed, readings).collect()}
    assert got == {0: ("given back", 0.6), 1: ("refused", 0.5), 2: ("no reading", None), 3: (None, None), 4: ("refused", 0.0), 5: ("no reading", None)}


def test_of_equally_like_texts_the_last_is_best_whatever_the_order():
    text = "".join(chr(97 + k % 26) for k in range(49))  # 1 / 49 * 49 isn't 1 in floating point
    for ids in ([0, 1, 2], [2, 0, 1], [1, 0, 2]):
        assert L.best_of(text, L.Texts([text] * 3), ids, 9, 0.5) == (1.0, 2)


def test_likeness_to_the_own_line_is_worked_out_once(page_lines):
    for found, most in ((attachment.misattached(page_lines), 1), (attachment.margin_veto(page_lines), 0)):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("EvalPython") <= most
