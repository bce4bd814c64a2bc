"""The operators against brute force, exact round trips and held-out accuracy, with odd inputs."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.llm import byte_bpe, fingerprint, hashing, matroska, minhash, packing, queries, repeats, suffix_dedup, token_store, toxicity, window_index, wrappers
from pagewright.llm.common import flat
from pagewright.llm.segments import library_ids

tokenizers_dir = pytest.importorskip("public_tokenizers")
ODD = ["", " ", "a", "a  b\n", "\n\n", "x" * 3000, "İ Σς ß 中文 字", "don't 'll 's's x'", "a\tb \x1c c\u0085 d", "<|endoftext|>", "à. b,, .c", " \t\n"]


@pytest.fixture(scope="module")
def documents(spark):
    """Copies, near copies, repeated passages, ties, nulls, an empty text, a repeated row and clashing columns."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(r.randint(1, 160))) for _ in range(30)]
    texts += [texts[3], texts[3], texts[5] + " tail", passage + " " + texts[7], texts[8] + "\n" + passage, "ab " * 120, "ab " * 40]
    long = " ".join(word() for _ in range(140)).split()
    texts += [" ".join(long[:k] + [word()] + long[k + 1 :]) for k in (5, 70, 130)] + [" ".join(long)] + ODD
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)]
    rows += [(900, None, 1, None), (None, "no name", 1, 2), rows[2]]
    return spark.createDataFrame(rows, "doc_id long, text string, start int, key long")


def kept_rows(documents):
    """What the operators take: unique ids, null text as empty."""
    return sorted({(r["doc_id"], r["text"] or "") for r in documents.collect() if r["doc_id"] is not None})


def empty(documents):
    return documents.where("false")


@pytest.mark.parametrize("most", [2000, 0])
def test_suffix_dedup(documents, monkeypatch, most):
    monkeypatch.setattr(repeats, "GROUP_MOST", most)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digest(suffix_dedup.dedup(documents, 40)).collect()}
    seen, want = set(), {}
    for key, text in kept_rows(documents):
        raw = text.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 39):
            if raw[s : s + 40] in seen:
                gone[s : s + 40] = b"\1" * 40
            seen.add(raw[s : s + 40])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        want[key] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    assert got == want
    assert suffix_dedup.dedup(empty(documents)).count() == 0


def test_suffix_array():
    data = np.frombuffer(b"abracadabra" * 5 + b"\0\0abra", np.uint8)
    order, _ = suffix_dedup.suffix_array(data, 20)
    raw = data.tobytes()
    assert [raw[i : i + 20] for i in order] == sorted(raw[i : i + 20] for i in range(len(raw)))
    common = suffix_dedup.common_prefixes(data, order, 20)
    for k in range(1, len(order)):
        a, b = raw[order[k - 1] :], raw[order[k] :]
        assert common[k] == min(20, next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))))


@pytest.mark.parametrize("most", [2000, 0])
def test_window_index(documents, monkeypatch, most):
    monkeypatch.setattr(repeats, "GROUP_MOST", most)
    got = {r["doc_id"]: tuple(r)[1:] for r in window_index.digest(window_index.dedup(documents, 20)).collect()}
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t) for k, t in kept_rows(documents)}
    count = Counter(tuple(w[s : s + 20]) for w in words.values() for s in range(len(w) - 19))
    for key, w in words.items():
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            if count[tuple(w[s : s + 20])] > 1:
                gone[s : s + 20] = [True] * 20
        assert got[key] == (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    assert window_index.dedup(empty(documents)).count() == 0


def test_index_runs(spark):
    """Each batch's matches with itself and with the history, before and after runs are merged."""
    index = window_index.FingerprintIndex(spark)
    batch = lambda *keys: spark.createDataFrame([(k, False) for k in keys], "key long, twice boolean")
    hits = [sorted(r["key"] for r in index.add(batch(*b)).distinct().collect()) for b in ((1, 2, 2, 3), (3, 4), (1, 4, 5), (5, 6, 2))]
    assert hits == [[2], [3], [1, 4], [2, 5]] and len(index.runs) == 2
    index.compact()
    assert {r["key"]: r["n"] for r in index.rows().collect()} == {1: 2, 2: 3, 3: 2, 4: 2, 5: 2, 6: 1} and len(index.runs) == 1
    plan = index.run(index.runs[0]).join(index.run(index.runs[0]).select("key"), "key", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("BroadcastExchange", "") or "BroadcastHashJoin" in plan
    index.delete()


def brute_components(rows, size, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for key, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(low))
        sets[key] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    label = {k: k for k in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return {k: (len(sets[k]), label[k], label[k] == k) for k in sets}


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_minhash(documents, size, percent):
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash.near_duplicates(documents, size, percent).collect()}
    assert got == brute_components(kept_rows(documents), size, percent)
    assert minhash.near_duplicates(empty(documents)).count() == 0


def test_minhash_chain_and_blocks(spark, monkeypatch):
    """A long chain whose ends share little, in buckets larger than a block."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    r = random.Random(9)
    words, rows = [str(r.random()) for _ in range(60)], []
    for i in range(40):
        words[r.randrange(60)] = str(r.random())
        rows.append((i, " ".join(words)))
    got = {x["doc_id"]: tuple(x)[1:] for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == brute_components(rows, 3, 85)


def test_estimate():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 2**63, 3000).astype(np.uint64), r.integers(0, 2**63, 1000).astype(np.uint64)
    low = minhash.minima([a, np.concatenate([a[:2500], b])])
    bits = minhash.pack(low)
    assert abs(float(minhash.estimate(bits[0], bits[1])) - 2500 / 4000) < 0.2


def whole_ids(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizers_dir.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_stretches_give_the_ids_of_whole_texts(documents, name):
    texts = [t for _, t in kept_rows(documents)]
    library, encode = library_ids(tokenizers_dir.path(name)), whole_ids(name)
    got = []
    for _ in range(2):  # the second time from the cache
        got = [ids[a:b].tolist() for _, ids, at in library.batches(*flat(pa.array(texts))) for a, b in zip(at, at[1:])]
    assert got == [encode(t) for t in texts]


def test_packing(spark, documents):
    path = tokenizers_dir.path("byte_bpe_50k.json")
    encode, want = whole_ids("byte_bpe_50k.json"), Counter()
    for r in documents.collect():
        if r["doc_id"] is not None:
            ids = encode(r["text"] or "") + [2]
            at = 0
            for k, n in enumerate(packing.cut_lengths(len(ids), 64)):
                want[r["doc_id"], k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
                at += n
    rows = packing.pack(documents, path, 64, 2).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.pack(empty(documents), path).count() == 0


@pytest.mark.parametrize("least, most", [(1, 1024), (1, 300), (116, 116)])
def test_plan_is_tight(least, most):
    draw = random.Random(2)
    counts = dict(Counter(draw.randint(least, most) for _ in range(5000)))
    runs = packing.plan(counts, 1024)
    fill, ranks = Counter(), Counter()
    for length, lo, n, first, offset in runs:
        assert lo == ranks[length]
        ranks[length] += n
        for i in range(n):
            assert fill[first + i] == offset
            fill[first + i] += length
    assert ranks == Counter(counts) and max(fill.values()) <= 1024
    per = 1024 // least * least if least == most else 1024 / 1.05  # tokens that a sequence of such pieces can hold
    assert len(fill) <= sum(k * v for k, v in counts.items()) / per + 1


def test_fingerprint(documents):
    rows = kept_rows(documents)
    order = rows[::-1]
    got = {r["doc_id"]: r for r in fingerprint.edited(documents.dropDuplicates(["doc_id"])).collect()}
    for i, (key, text) in enumerate(order):
        after, half = order[(i + 1) % len(order)][1], len(text) // 2
        new = text[: len(text) - half] + after[:half]
        r = got[key]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert r["fingerprint"] == fingerprint.of(text).hex() and r["edited_fingerprint"] == fingerprint.of(new).hex()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    a, b = fingerprint.of("x\ny y\nz"), fingerprint.of("z\nx\ny y")
    assert a.hex() == b.hex() and a.add([b"z"], -1).hex() == fingerprint.of("y y\nx").hex()
    assert fingerprint.edited(empty(documents)).count() == 0


def test_matroska(documents):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in documents.collect() if r["doc_id"] is not None]
    got = matroska.read_media(matroska.to_media(documents)).collect()
    want = Counter((k, len(b), hashlib.sha256(matroska.padded(b)).hexdigest(), zlib.crc32(matroska.padded(b)[-16:])) for k, b in rows)
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    assert matroska.packet_table(matroska.to_media(documents)).where("byte_end <= byte_start").count() == 0
    # Xiph and EBML lacing, which other writers use.
    xiph = b"\x81\0\5\x02" + bytes([2, 255, 1, 3]) + b"a" * 256 + b"bbb" + b"cc"
    assert [y - x for x, y in matroska.frames_of(xiph, 0, len(xiph))[2]] == [256, 3, 2]
    ebml = b"\x81\0\5\x06" + bytes([2]) + matroska.vint(5) + bytes([0x80 | (63 - 2)]) + b"a" * 5 + b"bbb" + b"cc"
    assert [y - x for x, y in matroska.frames_of(ebml, 0, len(ebml))[2]] == [5, 3, 2]


def test_token_store(spark, documents):
    encode, folder = whole_ids("word_bpe_49k.json"), token_store.new_folder(spark)
    unique = documents.dropDuplicates(["doc_id"])
    token_store.write(unique, tokenizers_dir.path("word_bpe_49k.json"), folder)
    at, want = 0, []
    for key, text in kept_rows(documents):
        ids = encode(text) + [2]
        want.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True))
        at += len(ids)
    assert sorted(tuple(r) for r in token_store.read(spark, folder).collect()) == want
    digests = [r[0] for r in spark.read.parquet(f"{folder}/chunks").select("digest").collect()]
    assert len(digests) == len(set(digests)) and len(token_store.root(spark, folder)) == 64
    assert token_store.combine(zlib.crc32(b"ab"), zlib.crc32(b"cde"), 3) == zlib.crc32(b"abcde")


def test_byte_bpe(documents):
    import tiktoken

    path = tokenizers_dir.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    whole = tiktoken.Encoding("own", pat_str=tokenizers_dir.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(3)
    parts = ["'", "s", "re", "ll", " ", "  ", "\n", "\t", "a", "é", "1", "٣", "!", " ", "中"]
    texts = [t for _, t in kept_rows(documents)] + ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(2000)]
    bpe = byte_bpe.byte_bpe(path)
    got = [ids[a:b].tolist() for _, ids, at in bpe.batches(*flat(pa.array(texts))) for a, b in zip(at, at[1:])]
    assert got == [whole.encode_ordinary(t) for t in texts]
    back = byte_bpe.decode(byte_bpe.encode(documents, path), path).collect()
    assert {r["doc_id"]: bytes(r["content"]).decode() for r in back} == dict(kept_rows(documents))


def test_wrappers(spark):
    page = '<html><body><div id="header"><a href="/">Site</a></div><ul class="menu"><li><a>x</a></li></ul><div id="content"><h1>T{0}</h1><p>One {0} &amp; more  text here.</p><p>Two<br>lines {0}</p><div class="share">Share</div></div><div class="comments"><p>nice {0} post</p></div><form><p>Form</p></form></body></html>'
    article = "<html><body><nav>n</nav><article><h1>A{0}</h1><p>Body {0}<p>Next</article><aside>s</aside><footer>f</footer></body></html>"
    rows = [(i, "http://a.example/1", page.format(i), 7) for i in range(6)] + [(10 + i, "http://b.example/", article.format(i), 7) for i in range(3)] + [(20, None, None, 7), (21, "x", "", 7), (None, "x", "<p>y", 7)]
    got = {r["page_id"]: r for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host int")).collect()}
    assert got[1]["text"] == "T1\n\nOne 1 & more text here.\n\nTwo lines 1" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[11]["text"] == "A1\n\nBody 1\n\nNext" and got[20]["text"] == "" and got[21]["text"] == "" and len(got) == 11
    assert wrappers.fold(["<li>", "#", "</li>", "<li>", "#", "</li>", "<li>", "#", "</li>"]) == ["(", "<li>", "#", "</li>", ")+"]
    assert "(?" in wrappers.align(["<p>", "#", "</p>"], ["<h1>", "#", "</h1>", "<p>", "#", "</p>"])


def test_wrapper_slots_take_the_text(spark):
    """A slot that never changes over a host's pages is left out, in the article as well."""
    page = '<html><body><article><h1>T{0}</h1><p>Body {0}</p><p class="licence">All rights kept</p></article></body></html>'
    rows = [(i, "http://one.example/", page.format(i)) for i in range(6)]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == f"T{r['page_id']}\n\nBody {r['page_id']}" for r in got) and len(got) == 6


def test_wrapper_slots_decide(spark):
    """One host with several layouts, copies, links, a titled header and a constant line inside the article."""
    body = lambda inner: f"<html><body><nav>n</nav>{inner}</body></html>"
    article = body('<article><header class="entry-header"><h1>T{0}</h1></header><p>Body {0}</p><p class="licence">All rights kept</p></article>')
    content, post = body('<div id="content"><p>Long plain text of page {0} and more of it</p></div>'), body('<div id="post"><p>Short {0}</p><dl><dt>k</dt><dd>v{0}</dd><dt>k</dt><dd>w</dd></dl></div>')
    links = body('<div id="content"><p><a href="/">A long list of links {0} and more of it, longer than all plain text of the host</a></p><p>Plain {0}</p></div>')
    one = "http://one.example/"
    rows = [(i, one, article.format(i)) for i in range(6)] + [(10 + i, one, content.format(i)) for i in range(6)] + [(20, one, post.format(1)), (30, one, links.format(1))]
    rows += [(40 + i, "http://copies.example/", body("<div><p>The same text</p></div>")) for i in range(7)] + [(50, None, article.format(50)), (51, None, content.format(51))]
    got = {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "T1\n\nBody 1"  # the title of a header with a class stays, the constant slot goes though it is in the article
    assert got[11] == "Long plain text of page 1 and more of it"  # another page's article empties nothing
    assert got[20] == "Short 1\n\nk\n\nv1\n\nk\n\nw" and got[30] == "Plain 1"
    assert all(got[40 + i] == "The same text" for i in range(7)) and got[50].startswith("T50\n\nBody 50") and got[51].startswith("Long plain")


def test_template_text_needs_no_number_of_pages(spark):
    from pagewright.llm import wrappers

    page = lambda k, tag: f"<body><div class=top>Read more of us</div><{tag}><p>Summary</p><div><p>Story {k} of the river and the {'old ' * k}mill.</p></div></{tag}></body>"
    rows = [(k, "http://two/x", page(k, "section")) for k in (1, 2)] + [(3, "http://alone/x", page(3, "article"))] + [(k, "http://same/x", page(7, "section")) for k in range(5, 12)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in (1, 2):  # two pages that differ tell what never changes
        assert "Read more" not in got[k] and f"Story {k} of" in got[k]
    assert got[3].startswith("Summary\n\nStory")  # one page alone tells nothing
    assert len({got[k] for k in range(5, 12)}) == 1 and "Story 7" in got[5]  # copies of one page, however many


def test_wrappers_match_their_pages(spark, monkeypatch):
    """Wrappers of random pages, merged in several rounds, match each page, and a slot's path is the page's."""
    monkeypatch.setattr(wrappers, "SLICE", 4)
    monkeypatch.setattr(wrappers, "FAN", 2)
    r = random.Random(11)

    def element(depth):
        tag = r.choice(["div", "p", "h2", "ul", 'div class="a"', "section"])
        inner = "".join(element(depth + 1) for _ in range(r.randint(1, 4))) if depth < 3 and r.random() < 0.6 else f"t{r.randrange(99)}"
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    streams = sorted({wrappers.read_page("<body>" + "".join(element(0) for _ in range(r.randint(1, 5))) + "</body>")[0] for _ in range(60)} | {""})
    frame = spark.createDataFrame([("h", s, 1) for s in streams], "host string, stream string, n long")
    (whole,) = wrappers.wrappers(frame).collect()
    paths = [p for p, _ in wrappers.texts_in(wrappers.parsed(whole["wrapper"].split()))]
    for s in streams:
        own = [p for p, _ in wrappers.texts_in(wrappers.parsed(s.split()))]
        assert [paths[k] for k in wrappers.matched(s, whole["wrapper"])] == own and wrappers.written(wrappers.parsed(s.split())) == s.split()
    stream = wrappers.read_page("<dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd></dl>")[0]
    assert stream == "<dl> ( <dt> # </dt> <dd> # </dd> )+ </dl>"
    deep = wrappers.read_page("<div>" * 3000 + "x" + "</div>" * 3000)
    assert len(deep[2]) == 1 and wrappers.matched(deep[0], deep[0]) == [0]


def test_toxicity(spark):
    r = random.Random(5)
    clean = lambda: " ".join(f"w{r.randrange(400)}" for _ in range(80))
    rows = [(i, clean() + (" vile rotten" if i % 8 == 0 else "")) for i in range(1600)]
    docs = spark.createDataFrame([*rows, (5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(0, 1600, 2)] + [(5000, None)], "doc_id long, toxic int")
    got = toxicity.classify(docs, labels).collect()
    held = [x for x in got if x["held_out"] and x["doc_id"] < 1600]
    assert held and all((x["predicted"] == 1) == (x["doc_id"] % 8 == 0) for x in held)
    assert all(x["predicted"] == 0 for x in got if x["doc_id"] >= 5000) and all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in got)
    assert toxicity.classify(docs, labels.where("false")).agg(F.max("score")).first()[0] == 0


def test_queries_are_registered(spark):
    names = sorted(queries.queries())
    assert [n.split("_")[0] for n in sorted(names, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 11)]


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, "/root/testdata/sf0.001")
        assert after.columns == docs.columns and 0 < after.count() <= docs.count()
        docs = after
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").select("doc_id").distinct().count() == docs.count()


def test_pipeline_stages_by_brute_force(spark, documents):
    """Each filtering stage on odd rows: nulls, ties, repeated and missing ids; then no rows at all."""
    import corpus_pipeline

    docs = documents.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    show = lambda frame: Counter((r["doc_id"], r["text"], r["n_chars"]) for r in frame.collect())
    rows, keyed = show(docs), kept_rows(documents)
    kept = brute_components(keyed, 5, 80)
    assert show(corpus_pipeline.drop_near_duplicates(spark, docs, "")) == Counter({r: n for r, n in rows.items() if r[0] is None or kept[r[0]][2]})

    words = {key: re.findall(r"[^\x20\x09-\x0D]+", text) for key, text in keyed}
    windows = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    want, nulls = Counter(), {r[0] for r in rows if r[1] is None}
    for key, text in keyed:
        w, gone = words[key], set()
        for i in range(len(w) - 34):
            if windows[tuple(w[i : i + 35])] > 1:
                gone |= set(range(i, i + 35))
        cut = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else text
        want[key, None if key in nulls else cut, len(cut)] += 1
    want.update({r: n for r, n in rows.items() if r[0] is None})
    assert any(t is not None and (k, t) not in keyed for k, t, _ in want if k is not None)
    assert show(corpus_pipeline.cut_repeated_passages(spark, docs, "")) == want

    encode, ids = whole_ids("byte_bpe_50k.json"), {}
    for r in corpus_pipeline.pack(spark, docs, "").orderBy("piece").collect():
        assert r["start"] == sum(ids.setdefault(r["doc_id"], []))
        if r["doc_id"] != 2:  # its row stands there twice
            ids[r["doc_id"]].append(r["length"])
    assert {k: sum(n) for k, n in ids.items() if k != 2} == {k: len(encode(t)) + 1 for k, t in keyed if k != 2}
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.cut_repeated_passages, corpus_pipeline.pack):
        assert stage(spark, docs.where("false"), "").count() == 0


def test_pipeline_drops_what_is_toxic(spark, tmp_path):
    """Planted words decide; documents without text or id stay."""
    import corpus_pipeline

    r = random.Random(6)
    texts = [" ".join(f"w{r.randrange(400)}" for _ in range(80)) + (" vile rotten" if i % 8 == 0 else "") for i in range(1600)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(5000, None, "en", "s", 0), (5001, "", None, "s", 0), (None, texts[1], "en", None, 9)]
    spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(0, 1600, 2)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert Counter(map(tuple, got.collect())) == Counter(x for x in rows if " vile" not in (x[1] or ""))
    assert corpus_pipeline.drop_toxic(spark, docs.where("false"), str(tmp_path)).count() == 0


def thue_morse(n):
    """Two different words of which polynomial hashes modulo 2**64 are equal."""
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_regular_words_do_not_collide(spark):
    """Thue-Morse words as texts: ids, repeats and near copies are told apart."""
    import tiktoken

    a, b = thue_morse(4096)
    path = tokenizers_dir.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(path, "rb"))}
    whole = tiktoken.Encoding("own", pat_str=tokenizers_dir.PATTERN, mergeable_ranks=ranks, special_tokens={})
    _, ids, at = next(byte_bpe.byte_bpe(path).batches(*flat(pa.array([a, b]))))
    assert [ids[x:y].tolist() for x, y in zip(at, at[1:])] == [whole.encode_ordinary(a), whole.encode_ordinary(b)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        _, ids, at = next(library_ids(tokenizers_dir.path(name)).batches(*flat(pa.array([a, b]))))
        assert [ids[x:y].tolist() for x, y in zip(at, at[1:])] == [whole_ids(name)(a), whole_ids(name)(b)]
    spelt = [" ".join(x[:400]).replace("a", "xa").replace("b", "yb") for x in (a, b)]
    docs = spark.createDataFrame(list(enumerate([*spelt, a, b])), "doc_id long, text string")
    texts = [(i, t) for i, t in enumerate([*spelt, a, b])]
    words = {k: t.split() for k, t in texts}
    count = Counter(tuple(w[s : s + 35]) for w in words.values() for s in range(len(w) - 34))
    for r in window_index.dedup(docs, 35).collect():
        w, gone = words[r["doc_id"]], set()
        for s in range(len(w) - 34):
            if count[tuple(w[s : s + 35])] > 1:
                gone |= set(range(s, s + 35))
        assert r["n_removed"] == len(gone)
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash.near_duplicates(docs, 3, 85).collect()}
    assert got == brute_components(texts, 3, 85)


def test_stretches_with_one_hash_are_told_apart(monkeypatch):
    """Even if all hashes were equal, ids would be right."""
    library = type(library_ids(tokenizers_dir.path("byte_bpe_50k.json")))(tokenizers_dir.path("byte_bpe_50k.json"))
    library.hashed = lambda data, start, end: np.zeros(len(start), np.uint64)
    texts = ["one two three", "four, five", "", "one six"]
    for _ in range(2):
        _, ids, at = next(library.batches(*flat(pa.array(texts))))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [whole_ids("byte_bpe_50k.json")(t) for t in texts]
    monkeypatch.setattr(hashing, "byte_spans", lambda data, start, end, seed=0: np.zeros(len(start), np.uint64))
    data, offsets = flat(pa.array(["ab cd ab"]))
    assert hashing.names(data, np.array([0, 3, 6]), np.array([2, 5, 8])).tolist() == [0, 1, 0]


def test_random_texts_keep_the_librarys_ids():
    r = random.Random(12)
    parts = ["a", "Bc", "é", "Ω", "中", " ", "  ", "\n", "\t", ".", ",", "'", "s", "1", "23", "-", "\u00a0", "😀", "ß", "İ", "\u0301", "<", "|", "’"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library, encode = library_ids(tokenizers_dir.path(name)), whole_ids(name)
        got = [ids[a:b].tolist() for _, ids, at in library.batches(*flat(pa.array(texts))) for a, b in zip(at, at[1:])]
        assert got == [encode(t) for t in texts]


def test_fingerprints_of_very_repetitive_texts():
    a, b = fingerprint.of("one line\n" * 65536), fingerprint.of("another thing\n" * 65536)
    assert fingerprint.likeness(fingerprint.lanes(a.hex()), fingerprint.lanes(b.hex())) < 0.3


def test_matroska_of_other_writers():
    """Clusters and a segment of unknown size, another timestamp scale, a track without a frame duration, laces of one."""
    m = matroska
    track = m.element(m.TRACKS, m.element(m.ENTRY, m.number(m.NUMBER, 1) + m.element(m.CODEC, b"A_OPUS")))
    info = m.element(m.INFO, m.number(m.SCALE, 500_000))
    key = lambda k: k.to_bytes((k.bit_length() + 7) // 8, "big")
    block = lambda flags, body: m.element(m.SIMPLE, b"\x81\0\4" + bytes([flags]) + body)
    cluster = lambda t, blocks: key(m.CLUSTER) + b"\x01" + b"\xff" * 7 + m.number(m.TIMESTAMP, t) + blocks
    body = info + track + cluster(0, block(0, b"one")) + cluster(100, block(6, b"\0two")) + cluster(200, block(2, b"\0xyz") + block(4, bytes([1]) + b"aabb"))
    raw = m._HEAD + key(m.SEGMENT) + b"\xff" + body
    got = m.packets(raw)
    assert [(t, raw[a:b]) for _, t, a, b in got] == [(2, b"one"), (52, b"two"), (102, b"xyz"), (102, b"aa"), (102, b"bb")]
    at = raw.index(track) + 5
    assert m.tracks(raw, at, at + len(track) - 5) == {1: (0, "A_OPUS")}


def test_word_hashes_depend_on_nothing_but_the_word():
    data, offsets = flat(pa.array(["ab cd", "x ab", "Ab"]))
    _, _, h, first = hashing.words(data, offsets)
    assert h[0] == h[3] and h[0] != h[4] and first.tolist() == [0, 2, 4, 5]
    assert hashing.words(data, offsets, lower=True)[2][4] == h[0]
    assert repeats.GROUP_MOST > 0
