"""Connected components in few rounds, and what the driver keeps."""

import random

from pagewright.llm import minhash, toxicity


def brute(edges):
    above = {x: x for e in edges for x in e}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        above[y] = x
    return {(x, top(x)) for x in above if top(x) != x}


def test_components_take_no_round_for_what_are_stars(spark, monkeypatch):
    staged = []
    stage = minhash.stage
    monkeypatch.setattr(minhash, "stage", lambda frame, name: staged.append(name) or stage(frame, name))
    r = random.Random(4)
    shapes = {
        "stars": ([(1, x) for x in range(5, 90)] + [(x, 2) for x in range(100, 120)] + [(7, 7), (1, 5)], 1),
        "none": ([], 1),
        "loops": ([(3, 3)], 1),
        "path": ([(x, x + 1) for x in range(40)], None),
        "any": ([(r.randrange(300), r.randrange(300)) for _ in range(220)], None),
    }
    for edges, rounds in shapes.values():
        staged.clear()
        got = [tuple(x) for x in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()]
        assert len(got) == len(set(got))
        assert {x for x in got if x[0] != x[1]} == brute(edges)
        assert rounds is None or len(staged) == rounds


def test_training_gives_the_drivers_memory_back(spark, monkeypatch):
    called = []
    monkeypatch.setattr(toxicity, "give_back", lambda: called.append(1))
    docs = spark.createDataFrame([(k, f"word{k % 5} other{k}") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 5 == 0 and 1 or 0) for k in range(40)], "doc_id long, toxic int")
    toxicity.train(docs, labels)
    assert called
