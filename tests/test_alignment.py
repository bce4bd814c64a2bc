"""Many pairs aligned at once, against difflib and against the kernels for one row."""

import random
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest

from pagewright.functions import alignment, arrays, kernels, likeness


def by_pair(pairs):
    out = [[] for _ in pairs]
    for p, *block in zip(*(x.tolist() for x in alignment.many_blocks(*alignment.coded([a for a, _ in pairs]), *alignment.coded([b for _, b in pairs])))):
        out[p].append(tuple(block))
    return out


def by_difflib(a, b):
    return [tuple(m) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]


def some_pairs(rng, n, longest):
    for _ in range(n):
        letters = rng.choice(["a", "ab", "abc ", "abcdefgh ijkl"])
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(longest)))
        b = rng.choice([a, "".join(c for c in a if rng.random() < 0.9), a[len(a) // 2 :] + a[: len(a) // 2], "".join(rng.choice(letters) for _ in range(rng.randrange(longest)))])
        yield a, b


@pytest.mark.parametrize("seeds", [1 << 20, 40])
def test_many_blocks(seeds, monkeypatch):
    """Also where ranges have more pairs of equal stretches than are held at once."""
    monkeypatch.setattr(alignment, "SEEDS", seeds)
    monkeypatch.setattr(alignment, "LETTERS_AT_ONCE", 2000)
    pairs = [("", ""), ("", "a"), *some_pairs(random.Random(1), 400, 90)]
    assert by_pair(pairs) == [by_difflib(*p) for p in pairs]


def test_long_pairs_of_many_letters():
    """Stretches of 16 and 64 letters, whose numbers are pairs of pairs of pairs."""
    rng = random.Random(4)
    words = ["".join(chr(rng.randrange(97, 160)) for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    for n in (100, 1200):
        text = " ".join(rng.choice(words) for _ in range(n))
        read = "".join(c for k, c in enumerate(text) if k % 17)
        assert by_pair([(read, text), (text, read)]) == [kernels.blocks(read, text), kernels.blocks(text, read)]


def test_values_of_many_pairs():
    pairs = [(a.upper() if k % 3 else a, b + "\n" + a[:9]) for k, (a, b) in enumerate(some_pairs(random.Random(7), 200, 60))] + [("", "")]
    one, two = ([p[k] for p in pairs] for k in (0, 1))
    assert alignment.supports(one, two).tolist() == [kernels.support(a, b) for a, b in pairs]
    assert alignment.likenesses(one, two).tolist() == [likeness.likeness(a, b) for a, b in pairs]
    words = alignment.Words(two)
    flags = words.anchored(one).tolist()
    assert [flags[lo:hi] for lo, hi in zip(words.places, words.places[1:])] == [kernels.anchored(a, b) for a, b in pairs]
    pages = [(a.replace(" ", "\n").split("\n"), b.split("\n")) for a, b in pairs]
    assert alignment.reprojected(pages) == [kernels.reproject(a, b) for a, b in pages]
    assert alignment.signals(pages) == [tuple(map(len, kernels.signals(a, b))) for a, b in pages]
    assert [[tuple(x) for x in own.tolist()] for own in alignment.stretches_of(*alignment.coded(one), *alignment.coded(two))] == [kernels.opcodes(a, b) for a, b in pairs]


def test_readings_of_many_rows():
    """Boxes of a batch are those of its rows, with letter widths and without."""
    rng, rows = random.Random(3), []
    for _ in range(300):
        tokens = [t for k in range(rng.randrange(6)) for t in ([rng.choice([" ", " ", "  "])] if k else []) + ["".join(rng.choice("abcde éfB") for _ in range(rng.randrange(1, 9)))]]
        text = "".join(tokens)
        read = None if rng.random() < 0.05 else "".join(c for c in text if rng.random() > 0.2)
        edges = np.cumsum([100, *(rng.randrange(3, 9) for _ in read or "")]).tolist()
        spans = [{"x0": x, "x1": y} for x, y in zip(edges, edges[1:])][: -1 if rng.random() < 0.05 else None]
        arms = [None if rng.random() < 0.4 else {c: 2 * rng.random() for c in rng.sample("abcdef", rng.randrange(5))} for _ in range(2)]
        rows.append((read, spans, tokens, rng.randrange(90, 110), rng.randrange(300), arms))
    kinds = pa.string(), pa.list_(pa.struct([("x0", pa.int64()), ("x1", pa.int64())])), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.list_(pa.map_(pa.string(), pa.float64()))
    columns = [pa.array([[None if g is None else list(g.items()) for g in x] for x in c] if k == 5 else c, kind) for k, (c, kind) in enumerate(zip(zip(*rows), kinds))]
    for (read, spans, tokens, hpos, width, arms), got in zip(rows, arrays.aligned_of.func(*columns).to_pylist()):
        assert got["support"] == (None if read is None else kernels.support(read, "".join(tokens)))
        for glyphs, arm in zip(arms, got["arms"]):
            if read is None or len(read) != len(spans):
                assert arm == {"boxes": None, "error": "missing line" if read is None else "text and spans differ"}
                continue
            want, why = kernels.transfer(read, [(s["x0"], s["x1"]) for s in spans], tokens, hpos, width, glyphs)
            assert arm["error"] == why and (want is None) == (arm["boxes"] is None)
            assert want is None or [(b["text"], b["hpos"], b["width"]) for b in arm["boxes"]] == want


@pytest.mark.parametrize("twin", [None, 0.7])
def test_best_of_each(twin, monkeypatch):
    """Of every text the best other one, as one text after the other finds it."""
    monkeypatch.setattr(likeness, "STATES", 40)
    rng = random.Random(9)
    bodies = [a[:200] for a, _ in some_pairs(rng, 60, 260)] + ["", "ab" * 70, "ab" * 70, "abc " * 50]
    among, ids = likeness.Texts(bodies), list(range(100, 100 + len(bodies)))
    texts = [rng.choice([b, b[:40][::-1] + b, b.upper()]) for b in bodies]
    floors, own_texts = [rng.choice([0.05, 0.4, 0.8]) for _ in texts], [rng.choice(bodies) for _ in texts]
    spare = lambda own: (lambda i: likeness.likeness(own, bodies[i]) >= twin) if twin else None
    want = [likeness.best_of(t, among, ids, k, f, spare(own)) for t, k, f, own in zip(texts, ids, floors, own_texts)]
    assert likeness.best_of_each(texts, among, bodies, ids, ids, floors, own_texts, twin) == want
    numbers = [among.numbers(t.casefold()) for t in texts if t]
    which, others = (x.ravel() for x in np.meshgrid(np.arange(len(numbers)), np.arange(len(bodies))))
    got = likeness.common_subsequences(numbers, which, among, others)
    for k in rng.sample(range(len(which)), 300):
        assert got[k] == likeness.common_subsequence(numbers[which[k]], among.matrix(others[k : k + 1]), len(among.letters))[0]


def test_distances(monkeypatch):
    monkeypatch.setattr(likeness, "STATES", 60)
    rng = random.Random(11)
    pairs = [("", ""), ("", "abc"), ("a" * 70, "b" * 65), *some_pairs(rng, 150, 90), *some_pairs(rng, 20, 300)]
    pairs += [(a, a[:20] + "x" + a[20:].replace("a", "b")) for a, _ in pairs]
    assert likeness.distances([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [kernels.distance(a, b) for a, b in pairs]
