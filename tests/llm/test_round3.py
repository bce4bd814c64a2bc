"""Spelling variants, the conversation trie and line dedup against brute force, with odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagewright.llm import common, line_index, prefix_trie, spellings, toxicity


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def texts(spark):
    """Words with variants, repeated lines of several kinds, ties, nulls, repeated ids and rows, and clashing columns."""
    r = random.Random(11)
    stem = ["abcdef", "abcdeg", "abdcef", "éabcdef", "aabcdef", "abcdeff", "aaaaaaa", "aaaaaa", "ÀBCDEFG", "zzzzzzzz", "straße", "strasse"]
    words = [w for w in stem for _ in range(r.choice([5, 6, 30, 40, 200]))]
    words += [w[:k] + r.choice("abcé") + w[k:] for w in stem for k in (0, 2, len(w)) for _ in range(5)]
    r.shuffle(words)
    line = ["a line that many documents share", "  A LINE that many documents share\t", "x" * 19, "y" * 20, "", " " * 30, " " + "z" * 19, "another line, of two documents"]
    rows = []
    for k in range(40):
        own = " ".join(words[k::40])
        rows.append((k, "\n".join([own, *(r.choice(line) for _ in range(4)), f"only here {k} and nowhere else"]), 1, 2, 3))
    rows += [(7, rows[9][1], 1, 2, 3), rows[3], (None, rows[4][1], 1, 2, 3), (None, line[0], 1, 2, 3), (50, None, 1, 2, 3), (51, "", 1, 2, 3), (52, "\n", 1, 2, 3), (53, (line[0] + "\n") * 3000 + "long " * 20000, 1, 2, 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, n int, word int, key int")


def brute_spellings(rows):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    v = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by = {w: [u for u in v if near(w, u)] for w in v}
    form = {}
    for w, own in by.items():
        top = min(own, key=lambda u: (-v[u], u), default=None)
        if top is not None and v[top] >= 5 * v[w]:
            form[w] = top

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), v[w], len(by[w]), v.get(form.get(w))) for w in v}


@pytest.mark.parametrize("most", [spellings.GROUP_MOST, 0, 3])
def test_spellings(texts, monkeypatch, most):
    monkeypatch.setattr(spellings, "GROUP_MOST", most)
    got = spellings.variants(spellings.vocabulary(spellings.words(texts))).collect()
    want = brute_spellings([(r["doc_id"], r["text"]) for r in texts.collect()])
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want
    assert len(got) == len(want) and any(w[0] for w in want.values()) and any(w[3] > 3 for w in want.values())
    assert spellings.variants(spellings.vocabulary(spellings.words(texts.where("false")))).count() == 0


def test_neighbourhood_is_full_and_distinct():
    """All edits of a word, each once: what the halves leave out of each other's reach is made by the other one."""
    letters = np.frombuffer(b"abc", np.uint8)
    for word in (b"abcabc", b"aaaaaaa", b"abbccca", b"cabbage"):
        matrix, made, hashes = np.frombuffer(word, np.uint8)[None], [], []
        for longer in (False, True):
            for first in (True, False):
                for place, codes, h, valid in spellings.edits(matrix, longer, first, letters):
                    at = np.flatnonzero(valid.ravel())
                    rows = spellings.spelt(np.repeat(matrix, len(at), 0), longer, place, None if codes is None else codes[at % len(codes)])
                    made += [x.tobytes() for x in rows]
                    hashes += h.ravel()[at].tolist()
        n = len(word)
        want = {word[:i] + word[i + 1 :] for i in range(n)} | {word[:i] + bytes([c]) + word[j:] for i in range(n + 1) for j in (i, i + 1) for c in b"abc" if j <= n} - {word}
        assert sorted(made) == sorted(want)
        assert [int(spellings._valued(np.arange(len(m)), np.frombuffer(m, np.uint8)).sum(dtype=np.uint64)) for m in made] == hashes


def test_roots_follow_long_chains(spark):
    links = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(11)] + [("x", "w5"), ("y", "z")], "word string, form string")
    got = {r["word"]: r["root"] for r in spellings.roots(links).collect()}
    assert got == {**{f"w{k}": "w11" for k in range(11)}, "x": "w11", "y": "z"}
    assert spellings.roots(links.where("false")).count() == 0


def brute_trie(rows):
    turns = defaultdict(list)
    for key, turn, role, text in rows:
        if key is not None:
            role, text = role or "", text or ""
            turns[key].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    turns = {key: [t[-1] for t in sorted(own)] for key, own in turns.items()}
    paths = {}
    for key in turns:
        h = zlib.crc32(str(key).encode()) % 6
        paths[key] = turns.get(key - int(np.fmod(key, 100)), [])[:h] + turns[key][h:]
    members, kids = defaultdict(list), defaultdict(set)
    for key, path in paths.items():
        for depth in range(len(path) + 1):
            members[tuple(path[:depth])].append(key)
    for node in members:
        if node:
            kids[node[:-1]].add(node)

    def below(node):
        leaves, saved = int(not kids[node]), (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        for kid in kids[node]:
            more = below(kid)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    out = []
    for node, own in members.items():
        ends = ",".join(str(k) for k in sorted(own) if len(paths[k]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids[node]), *below(node), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def conversations(spark):
    r = random.Random(1)
    keys = [None, *range(-120, -100), -3, *range(30), *range(100, 140), 200, 205, 4095, 4096, 5000, 99999]
    rows = [(r.choice(keys), r.choice([None, 0, 1, 2, 3]), r.choice(["u", "a", None]), r.choice(["x", "y", "", None, "zé"]), 5) for _ in range(600)]
    rows += [(9000 + k, t, "user", "very long " * 9000 if t == 3 else "common", 5) for k in range(60) for t in range(4)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node int")


@pytest.mark.parametrize("hot, bits", [(common.HOT, 12), (2, 2)])
def test_prefix_trie(conversations, monkeypatch, hot, bits):
    monkeypatch.setattr(common, "HOT", hot)
    monkeypatch.setattr(prefix_trie, "STRETCH_BITS", bits)
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns_of(conversations))).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_trie([tuple(r)[:4] for r in conversations.collect()])
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns_of(conversations.where("false")))).count() == 0


def brute_lines(rows):
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    n, owner = Counter(), {}
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 20:
                n[k] += 1
                if doc is not None:
                    owner[k] = max(owner.get(k, doc), doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if n[key(x)] < 3 or owner.get(key(x), doc) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot, batches", [(common.HOT, 4), (2, 3), (common.HOT, 1)])
def test_line_dedup(texts, monkeypatch, hot, batches):
    monkeypatch.setattr(common, "HOT", hot)
    got = line_index.digest(line_index.dedup(texts, batches=batches)).collect()
    want = brute_lines([(r["doc_id"], r["text"]) for r in texts.collect()])
    assert sorted((tuple(r) for r in got), key=repr) == want and sum(r[2] for r in want) > 50
    assert line_index.dedup(texts.where("false"), batches=batches).count() == 0


def test_line_index_levels(spark, tmp_path):
    """Runs are merged level by level, settled keys aren't added again, and another job finds the index as it was left."""
    folder = f"file://{tmp_path}/index"
    index = line_index.LineIndex(spark, folder)
    batch = lambda doc, *keys: spark.createDataFrame([(k.encode(), d) for d in doc for k in keys], "key binary, doc_id long")
    index.add(batch((8, 9, 10), "a", "b"))
    index.add(batch((5,), "a", "c"))
    assert [len(level) for level in index.levels] == [0, 1]
    index = line_index.LineIndex(spark, folder)
    index.add(batch((11,), "a"))  # a larger id takes over
    index.add(batch((2, 3), "a", "c"))
    index.add(batch((1,), "d"))
    assert [len(level) for level in index.levels] == [1, 0, 1] and len(index.runs()) == 2
    again = line_index.LineIndex(spark, folder)
    assert again.levels == index.levels
    assert {(bytes(r["key"]), r["owner"]) for r in again.common().collect()} == {(b"a", 11), (b"b", 10), (b"c", 5)}
    rows = {bytes(r["key"]): r["n"] for r in again._merged(again.runs()).collect()}
    assert rows == {b"a": 4, b"b": 3, b"c": 3, b"d": 1}
    joined = spark.table(again.runs()[0]).join(spark.table(again.runs()[1]).hint("merge"), "key", "left_anti")
    assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    again.delete()


def test_lines_go_on_in_a_later_job(spark, tmp_path):
    folder = f"file://{tmp_path}/lines"
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    shared = "this line comes again and again"
    first = line_index.dedup(docs((10, shared), (11, shared)), folder=folder).collect()
    assert [r["n_dropped"] for r in first] == [0, 0]
    later = {r["doc_id"]: r["kept"] for r in line_index.dedup(docs((1, f"{shared}\nnew"), (2, "other")), folder=folder).collect()}
    assert later == {1: "new", 2: "other"}


@pytest.mark.parametrize("share", [0.1, 0.4, 1.0])
def test_toxicity_needs_evidence(spark, share):
    """However many labels are toxic: where no word marks them, and where a document has none of the words that do, it isn't."""
    r = random.Random(16)
    word = lambda: r.choice(["red", "green", "blue", "tree", "sky", "sea"])
    plain = [(k, " ".join(word() for _ in range(30))) for k in range(300)] + [(300, ""), (301, None), (302, " ")]
    labels = spark.createDataFrame([(k, int(k < 200 * share)) for k in range(200)], "doc_id long, toxic int")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.classify(frame(plain), labels).collect()
    assert len(got) == 303 and not any(x["predicted"] for x in got) and all(0 <= x["score"] <= toxicity.NO_EVIDENCE for x in got)
    marked = [(k, f"{t} vile{k % 3}" if k < 200 * share and k % 2 and t else t) for k, t in plain]
    got = toxicity.classify(frame(marked), labels).collect()
    texts = dict(marked)
    assert not any(x["predicted"] for x in got if "vile" not in (texts[x["doc_id"]] or ""))


def test_checksums_of_many_documents_are_combined_at_once():
    import random
    import zlib

    import numpy as np

    from pagewright.llm import token_store

    r = random.Random(5)
    sizes = [[r.choice([1, 2, 63, 64, 8192, r.randint(1, 8192)]) for _ in range(k)] for k in [0, 1, 2, 2, 3, *[r.randint(0, 4) for _ in range(40)], 30]]
    bodies = [[r.randbytes(4 * n) for n in own] for own in sizes]
    at = np.append(0, np.cumsum([len(own) for own in sizes]))
    crcs, n = np.array([zlib.crc32(b) for own in bodies for b in own]), np.array([n for own in sizes for n in own])
    assert token_store.combine_each(crcs, n, at).tolist() == [zlib.crc32(b"".join(own)) for own in bodies]
    assert token_store.combine_each(crcs[:1], np.array([9000]), np.array([0, 1, 1])).tolist() == [int(crcs[0]), 0]


def test_words_are_encoded_once_whatever_their_case_gap_or_mark():
    """op5_token_store: where a vocabulary lower-cases and drops white space, neither makes a new stretch of a word; nor do marks."""
    import public_tokenizers
    import pyarrow as pa

    from pagewright.llm.common import flat
    from pagewright.llm.segments import LibraryIds

    for name, most in (("word_bpe_49k.json", 5), ("byte_bpe_50k.json", 8)):
        library, seen = LibraryIds(public_tokenizers.path(name)), []
        learn = library.learn
        library.learn = lambda stretches: seen.extend(stretches) or learn(stretches)  # noqa: B023
        texts = ["Horse horse\nhorse horse$$$ horse%", "HORSE%", " horse$$$", "horse"]
        for _ in range(2):
            _, ids, at = next(library.batches(*flat(pa.array(texts))))
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(seen) <= most and len(seen) == len(set(seen))


def test_folded_texts_keep_the_librarys_ids(monkeypatch):
    """Letters that only one case of composes with a mark, contractions and marks next to letters, with a cache that overflows."""
    import random

    import public_tokenizers
    import pyarrow as pa

    from pagewright.llm import segments
    from pagewright.llm.common import flat

    monkeypatch.setattr(segments, "TABLE", 8)
    monkeypatch.setattr(segments, "CACHE_MOST", 4)
    monkeypatch.setattr(segments, "slices", lambda offsets: ((i, min(i + 7, len(offsets) - 1)) for i in range(0, len(offsets) - 1, 7)))
    r = random.Random(8)
    parts = ["H", "h", "J", "T", "W", "I", "K", "̱", "̌", "̈", "̊", "̇", "̸", "K", "É", "é", "×", "'S", "'ll", "'", "=", "<", "$", "7", "_", " ", "  ", "\n", "\r", "longerwordthansixteenletters"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(800)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library = segments.LibraryIds(public_tokenizers.path(name))
        got = [ids[a:b].tolist() for _, ids, at in library.batches(*flat(pa.array(texts))) for a, b in zip(at, at[1:])]
        assert got == [library.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
