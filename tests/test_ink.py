"""Thresholds, blank runs, cuts and uncovered ink against plain loops over pixels."""

import random

import numpy as np
import pytest

from pagewright.operators import ink


@pytest.fixture(scope="module")
def pictures():
    r = np.random.default_rng(3)
    out = {k: r.integers(0, 256, (h, w)) for k, (h, w) in enumerate([(9, 20), (1, 5), (40, 33)])}
    two = r.choice([30, 220], (12, 50), p=[0.3, 0.7])
    two[:, 10:14] = two[:, 30:31] = two[:, 40:] = 220
    return out | {3: two, 4: np.full((6, 8), 77), 5: np.zeros((4, 6), int), 6: np.array([[0, 255]] * 3)}


@pytest.fixture(scope="module")
def images(spark, pictures):
    rows = [(k, y, line.tolist(), 0) for k, picture in pictures.items() for y, line in enumerate(picture)]
    return spark.createDataFrame(rows, "image long, y long, row array<int>, level int")


def by_share(picture):
    best, at = -1.0, 0
    flat = picture.ravel()
    for t in range(256):
        dark = (flat <= t).sum() / flat.size
        spread = dark * (1 - dark) or 1e-9
        v = (flat.sum() / flat.size * dark - flat[flat <= t].sum() / flat.size) ** 2 / spread
        if v > best:
            best, at = v, t
    return at


def by_count(picture):
    best, at, flat = -1.0, 128, picture.ravel()
    for t in range(256):
        dark, light = flat[flat <= t], flat[flat > t]
        if dark.size and light.size:
            v = dark.size * light.size * (dark.sum() / dark.size - light.sum() / light.size) ** 2
            if v > best:
                best, at = v, t
    return at


def test_thresholds(images, pictures):
    got = {r["image"]: (r["at"], r["below"]) for r in ink.thresholds(images).collect()}
    assert got == {k: (by_share(p), by_count(p)) for k, p in pictures.items()}
    assert ink.thresholds(images.where("false")).count() == 0


@pytest.mark.parametrize("strict", [False, True])
def test_blank_runs(spark, images, pictures, strict):
    want = set()
    for k, p in pictures.items():
        blank = (p >= by_count(p)).all(0) if strict else (p > by_share(p)).all(0)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], blank.astype(int), [0]])))
        want |= {(k, int(a), int(b)) for a, b in zip(edges[::2], edges[1::2]) if b - a >= max(2, p.shape[0] // 8)}
    heights = spark.createDataFrame([(k, p.shape[0]) for k, p in pictures.items()], "image long, height int")
    got = ink.blank_runs(ink.columns(images), ink.thresholds(images), heights, strict).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and any(w[0] == 3 for w in want)


def test_cuts(spark, images, pictures):
    r = random.Random(4)
    cuts = [(k, j, r.randint(-4, 60), r.randint(-4, 60)) for k in pictures for j in range(30)]
    frame = spark.createDataFrame(cuts, "image long, k long, a long, b long")

    def state(k, x):
        p = pictures[k]
        return "outside" if not 0 <= x < p.shape[1] else "inked" if (p[:, x] <= by_share(p)).any() else "blank"

    far = [(k, j, state(k, a), state(k, b)) for k, j, a, b in cuts if abs(a - b) >= 15]
    states = ink.cut_states(frame, ink.columns(images), ink.thresholds(images))
    assert {(x["image"], x["k"], x["a_state"], x["b_state"]) for x in states.collect()} == set(far)
    total = ink.contingency(states).first()
    pairs = [(a, b) for *_, a, b in far]
    assert (total["cuts"], total["both_blank"], total["only_a"], total["only_b"], total["neither"]) == (len(far), *(pairs.count(x) for x in (("blank", "blank"), ("blank", "inked"), ("inked", "blank"), ("inked", "inked"))))
    assert total["a_outside"] == sum(a == "outside" for a, _ in pairs)


def test_uncovered(spark, images, pictures):
    r = random.Random(5)
    boxes = [(k, r.randint(-10, 60), r.randint(-10, 60), r.randint(0, 30), r.randint(0, 30), 0.7, 1.3) for k in pictures for _ in range(r.choice([0, 1, 4])) if k != 2] + [(2, 3, 4, 20, 10, 1.0, 1.0), (2, 10, 8, 20, 10, 1.0, 1.0)]
    frame = spark.createDataFrame(boxes, "image long, hpos int, vpos int, width int, height int, scale_x double, scale_y double")
    want = {}
    for k, p in pictures.items():
        dark, mask = p < by_count(p), np.zeros(p.shape, bool)
        for _, x, y, w, h, sx, sy in (b for b in boxes if b[0] == k):
            x0, x1, y0, y1 = (int(v) for v in ((x - w * 0.1) * sx, (x + (w + w * 0.1)) * sx, (y - h * 0.1) * sy, (y + (h + h * 0.1)) * sy))
            if x1 >= 0 and y1 >= 0:
                mask[max(y0, 0) : y1 + 1, max(x0, 0) : x1 + 1] = True
        ink_px, outside = int(dark.sum()), int((dark & ~mask).sum())
        want[k] = (ink_px, outside, outside / ink_px if ink_px else 0.0)
    got = {x["image"]: (x["ink"], x["outside"], x["uncovered"]) for x in ink.uncovered(images, frame, ink.thresholds(images)).collect()}
    assert got == want and 0 < want[2][1] < want[2][0]
