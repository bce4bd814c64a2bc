"""Operator 7: main-text extraction by wrappers inferred from pages of one host.

A page becomes a tree of tags (with class and id) and text slots.  Neighbouring elements of one label
fold into a repeated element, and neighbouring runs of two to eight labels into a repeated group.  Each
host's distinct trees are merged level by level: what only one of them has becomes optional.  That
gives a union-free regular expression over tags, groups and text slots which every page of the host
matches.  Its slots are numbered, and each distinct tree is matched with it to find which slot every
text of a page stands in.

Extraction keeps the texts in the slots that hold content.  The content region belongs to a page's own
layout, its distinct tree: the article (or main) elements if it has them, else the element that holds most of
the varying, link-poor text; there, blocks of links in slots that mostly hold links go too.  A slot is template
text if its text is the same on all pages that have it while other texts of these pages differ (copies of one
page tell nothing; if nothing else would be left, the slot stays).  Never kept are menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader comments, by element or
by class and id words; a header inside the article is kept whatever its class says.

Distinct trees are merged in slices of about SLICE trees, and the partial wrappers FAN at a time in as
many rounds as the largest host needs, so no task gets more for a host with a third of all pages.  A
null html gives an empty text; rows with a null page_id are left out; a null url is a host of its own
for each page_id; repeated rows give equal rows; an empty table gives an empty result.  Other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
import html
import re
import sys
import zlib
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage, tidy

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
NEVER = {"head", "nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "button", "select", "option", "textarea", "input", "dialog", "menu", "svg", "canvas", "object", "label", "title", "xmp"}
WORDS = {"ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disclaimer", "footer", "gdpr", "header", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup", "promo", "promotion", "related", "reply", "replies", "respond", "share", "sharing", "sidebar", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget", "disqus", "masthead", "search", "login", "signup"}
CLOSERS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead"}}
#: Distinct streams of a host, about, that one task merges before partial wrappers meet, and partial wrappers that meet in one.
SLICE, FAN = 64, 8
#: Labels of the longest run that folds into a repeated group.
LONGEST_GROUP = 8
# Trees are walked by recursion; a page may nest its elements deep.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 200_000))


def label_of(tag: str, attributes: str) -> str:
    """The tag with its class, id and role words, which tell template parts apart."""
    if not attributes or ("class" not in attributes and "id" not in attributes and "role" not in attributes and attributes.islower()):
        return tag
    words = [w for m in MARKS.finditer(attributes) for w in re.split(r"[^a-z]+", (m[2] or m[3] or m[4] or "").lower()) if w]
    return f"{tag}.{'.'.join(sorted(set(words)))}" if words else tag


def tokens(page: str):
    """(kind, value): ``<`` label, ``>`` tag, ``#`` text, ``b`` a line break; raw elements' content is passed over."""
    at, n, open_tags = 0, len(page), []
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            yield "#", page[at:]
            return
        if m.start() > at:
            yield "#", page[at : m.start()]
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in open_tags:
                while True:
                    top = open_tags.pop()
                    yield ">", top
                    if top == tag:
                        break
            elif tag in BLOCKS:
                yield "b", tag
            continue
        if tag in BLOCKS and "p" in open_tags:  # a block ends an open paragraph (and what stands open in it)
            k = len(open_tags) - 1 - open_tags[::-1].index("p")
            if not any(t in ("td", "th", "table", "button") for t in open_tags[k:]):
                while len(open_tags) > k:
                    yield ">", open_tags.pop()
        for k in range(len(open_tags) - 1, -1, -1):
            if open_tags[k] in CLOSERS.get(tag, ()):
                while len(open_tags) > k:
                    yield ">", open_tags.pop()
                break
            if open_tags[k] in ("ul", "ol", "dl", "table", "select"):
                break
        if tag in VOID or m[3].endswith("/"):
            if tag in ("br", "hr"):
                yield "b", tag
            continue
        yield "<", label_of(tag, m[3])
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            yield ">", tag
        else:
            open_tags.append(tag)
    while open_tags:
        yield ">", open_tags.pop()


INLINE_CUT = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}


def slots(page: str) -> list[tuple[tuple[str, ...], str, bool, tuple[int, ...]]]:
    """The page's text slots: (path of labels, text of the block, whether a link holds it, numbers of the elements), in page order.

    Texts of inline elements belong to their block; white space becomes one space; empty slots are left out."""
    out, path, ids, buffer, links, link_text, opened = [], [], [], [], 0, 0, 0

    def flush() -> None:
        nonlocal link_text
        text = " ".join(html.unescape("".join(buffer)).split())
        if text:
            own = [(p, i) for p, i in zip(path, ids) if p.partition(".")[0] not in INLINE_CUT or p.partition(".")[2]]
            out.append((tuple(p for p, _ in own), text, 2 * link_text > len(text), tuple(i for _, i in own)))
        buffer.clear()
        link_text = 0

    for kind, value in tokens(page):
        if kind == "#":
            buffer.append(value)
            if links:
                link_text += len(value)
        elif kind == "b":
            if value == "br":
                buffer.append(" ")
            else:
                flush()
        elif kind == "<":
            tag, _, mark = value.partition(".")
            if tag not in INLINE_CUT or mark:
                flush()
            links += tag == "a"
            path.append(value)
            opened += 1
            ids.append(opened)
        else:
            if path:
                top = path[-1]
                tag, _, mark = top.partition(".")
                if tag not in INLINE_CUT or mark:
                    flush()
                links -= tag == "a"
                path.pop()
                ids.pop()
    flush()
    return out


def tree(own: list[tuple[tuple[str, ...], str, bool, tuple[int, ...]]]) -> list[list]:
    """The page's elements that hold text, as items [label, optional, repeated, items inside, numbers of the texts].

    A text has the label ``#``; what :func:`folded` groups has the labels of its items in parentheses."""
    root: list[list] = []
    levels, open_ids = [root], ()
    for k, (labels, _, _, ids) in enumerate(own):
        same = 0
        while same < min(len(open_ids), len(ids)) and open_ids[same] == ids[same]:
            same += 1
        del levels[same + 1 :]
        for label in labels[same:]:
            levels[-1].append([label, False, False, [], []])
            levels.append(levels[-1][-1][3])
        levels[-1].append(["#", False, False, [], [k]])
        open_ids = ids
    return folded(root)


def folded(items: list[list]) -> list[list]:
    """Neighbours of one label become one repeated item, then neighbouring runs of labels one repeated group."""
    out: list[list] = []
    for x in items:
        x[3] = folded(x[3])
        if out and out[-1][0] == x[0]:
            out[-1] = joined(out[-1], x)
            out[-1][2] = x[0] != "#"
        else:
            out.append(x)
    for n in range(2, min(LONGEST_GROUP, len(out) // 2) + 1):
        labels, i, shorter = [x[0] for x in out], 0, []
        while i < len(out):
            group, j = labels[i : i + n], i + n
            while len(group) == n and labels[j : j + n] == group:
                j += n
            if j == i + n or len(group) < n:
                shorter.append(out[i])
                i += 1
                continue
            first = out[i : i + n]
            for k in range(i + n, j, n):
                first = merged(first, out[k : k + n])
            shorter.append([f"({' '.join(group)})", False, True, first, []])
            i = j
        out = shorter
    return out


def joined(x: list, y: list) -> list:
    """One item for two of the same label; the first one's numbers of texts are extended in place."""
    x[4].extend(y[4])
    return [x[0], x[1] or y[1], x[2] or y[2], merged(x[3], y[3]), x[4]]


def merged(a: list[list], b: list[list]) -> list[list]:
    """One expression for both: what only one has becomes optional.  Neighbours never get the same label by this."""
    own, other = [x[0] for x in a], [x[0] for x in b]
    if own == other:
        return [joined(x, y) for x, y in zip(a, b)]
    out: list[list] = []
    for kind, i1, i2, j1, j2 in SequenceMatcher(None, own, other, autojunk=False).get_opcodes():
        if kind == "equal":
            out += [joined(x, y) for x, y in zip(a[i1:i2], b[j1:j2])]
        else:
            out += [[x[0], True, *x[2:]] for x in [*a[i1:i2], *b[j1:j2]]]
    return out


def written(items: list[list]) -> list[str]:
    """The items as tokens: ``<x>``, ``</x>``, ``#``, ``( ... )+`` and ``(? ... )?``."""
    out: list[str] = []
    for label, optional, repeated, inside, _ in items:
        own = ["#"] if label == "#" else written(inside) if label[0] == "(" else [f"<{label}>", *written(inside), f"</{label}>"]
        own = ["(", *own, ")+"] if repeated else own
        out += ["(?", *own, ")?"] if optional else own
    return out


def parsed(items: list[str]) -> list[list]:
    """The items that :func:`written` wrote."""
    levels: list[list[list]] = [[]]
    for x in items:
        if x == "#":
            levels[-1].append(["#", False, False, [], []])
        elif x in ("(", "(?") or (x[0] == "<" and x[1] != "/"):
            levels.append([])
        else:
            own = levels.pop()
            if x == ")?":
                own = [[o[0], True, *o[2:]] for o in own]
            elif x == ")+":
                own = [[own[0][0], own[0][1], True, *own[0][3:]]] if len(own) == 1 else [[f"({' '.join(o[0] for o in own)})", False, True, own, []]]
            else:
                own = [[x[2:-1], False, False, own, []]]
            levels[-1] += own
    return levels[0]


def texts_in(items: list[list], path: tuple[str, ...] = ()):
    """(path, item) of every text slot, in order."""
    for x in items:
        if x[0] == "#":
            yield path, x
        else:
            yield from texts_in(x[3], path if x[0][0] == "(" else (*path, x[0]))


def placed(own: list[list], whole: list[list]) -> list[int] | None:
    """For each text slot of a page's tree the number of the wrapper's slot that it matches; None if the wrapper doesn't match.

    The first of several matches is taken.  In the wrapper, a slot's numbers of texts hold the slot's number."""
    n, m = len(own), len(whole)
    known: dict[tuple[int, int], list[int] | None] = {}

    def fits(i: int, j: int) -> list[int] | None:
        if (i, j) not in known:
            x, y = own[i], whole[j]
            alike = x[0] == y[0] and x[1] <= y[1] and x[2] <= y[2]
            known[i, j] = None if not alike else list(y[4]) if x[0] == "#" else placed(x[3], y[3])
        return known[i, j]

    good = [[False] * (m + 1) for _ in range(n + 1)]
    good[n][m] = True
    for i in range(n, -1, -1):
        for j in range(m - 1, -1, -1):
            good[i][j] = (i < n and good[i + 1][j + 1] and fits(i, j) is not None) or (whole[j][1] and good[i][j + 1])
    if not good[0][0]:
        return None
    out, i = [], 0
    for j in range(m):
        if i < n and good[i + 1][j + 1] and fits(i, j) is not None:
            out += fits(i, j)
            i += 1
    return out


def matched(own: str, wrapper: str) -> list[int]:
    """The wrapper's slot numbers for a stream's text slots."""
    whole = parsed(wrapper.split())
    for k, (_, x) in enumerate(texts_in(whole)):
        x[4].append(k)
    out = placed(parsed(own.split()), whole)
    if out is None:
        raise ValueError("a wrapper doesn't match a page that it was made from")
    return out


def fold(items: list[str]) -> list[str]:
    """Neighbouring repeats become one repeated element or group: ``( ... )+``."""
    return written(folded(parsed(items)))


def align(a: list[str], b: list[str]) -> list[str]:
    """One expression for both streams: what only one has becomes an optional group."""
    return written(merged(parsed(a), parsed(b)))


@lru_cache(1 << 16)
def banned(path: tuple[str, ...]) -> bool:
    """Whether any element on the path is no content by its tag, class, id or role."""
    for k, label in enumerate(path):
        tag, _, mark = label.partition(".")
        # A header inside the article holds its title, not the site's, whatever its class says.
        if tag == "header" and any(x.partition(".")[0] in ("article", "main") for x in path[:k]):
            continue
        if tag in NEVER:
            return True
        if mark and tag not in ("html", "body", "article", "main") and WORDS.intersection(mark.split(".")):
            return True
    return False


def host_of(url, page_id) -> object:
    return F.when(url.isNull(), F.concat(F.lit("\0"), page_id.cast("string"))).otherwise(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)))


TEXTS = pa.list_(pa.struct([("leaf", pa.int32()), ("text", pa.string()), ("link", pa.bool_())]))
SIZES = pa.list_(pa.struct([("plain", pa.int64()), ("linked", pa.int64()), ("text", pa.int64())]))


def read_page(page: str) -> tuple[str, bytes, list[dict], list[dict]]:
    """(stream, digest of the texts that may be content, texts with their slots of the stream, what each of those slots holds)."""
    own = slots(page)
    items = tree(own)
    leaf_of, sizes, digest = [0] * len(own), [], hashlib.md5(usedforsecurity=False)
    for leaf, (path, x) in enumerate(texts_in(items)):
        size = [0, 0, 0]
        for k in x[4]:
            leaf_of[k] = leaf
            raw = own[k][1].encode("utf-8", "replace")
            size[own[k][2]] += len(own[k][1])
            size[2] = zlib.crc32(raw + b"\0", size[2])
            if not banned(path):
                digest.update(raw + b"\0")
        sizes.append({"plain": size[0], "linked": size[1], "text": size[2]})
    texts = [{"leaf": leaf, "text": text, "link": link} for leaf, (_, text, link, _) in zip(leaf_of, own)]
    return " ".join(written(items)), digest.digest(), texts, sizes


def page_slots(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, stream, digest, texts, sizes): each page's stream, its texts, and by slot of the stream how much plain and linked text it holds, with a checksum."""

    def run(batches):
        for batch in batches:
            rows = [read_page(page) for page in batch.column("html").to_pylist()]
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            made = [pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.binary(), TEXTS, SIZES))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("host"), *made], ["page_id", "url", "host", "stream", "digest", "texts", "sizes"])

    kind = "page_id long, url string, host string, stream string, digest binary, texts array<struct<leaf:int,text:string,link:boolean>>, sizes array<struct<plain:long,linked:long,text:long>>"
    return pages.select("page_id", "url", "host", "html").mapInArrow(tidy(run), kind)


def wrappers(unique: DataFrame) -> DataFrame:
    """(host, wrapper): each host's union-free expression, from its distinct streams (host, stream, n)."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        expression = None
        for s in group.sort_values(["n", "stream"], ascending=[False, True])["stream"]:
            own = parsed(s.split())
            expression = own if expression is None else merged(expression, own)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "slice": [int(group["slice"].iloc[0])], "stream": [" ".join(written(expression))], "n": [int(group["n"].sum())]})

    kind = "host string, slice long, stream string, n long"
    slices = unique.groupBy("host").agg(F.ceil(F.count("*") / SLICE).alias("slices"))
    left = slices.agg(F.max("slices")).first()[0] or 0
    partial = unique.join(slices, "host").select("host", F.pmod(F.xxhash64("stream"), F.col("slices")).alias("slice"), "stream", "n").groupBy("host", "slice").applyInPandas(merge, kind)
    while left > 1:
        partial = partial.withColumn("slice", F.floor(F.col("slice") / FAN)).groupBy("host", "slice").applyInPandas(merge, kind)
        left = -(-left // FAN)
    return partial.select("host", F.col("stream").alias("wrapper"))


def slot_numbers(unique: DataFrame, whole: DataFrame) -> DataFrame:
    """(host, stream, leaf, slot): the wrapper's slot that each text slot of a stream matches."""

    def run(batches):
        for batch in batches:
            hosts, streams, leaves, numbers = [], [], [], []
            for host, s, w in zip(*(batch.column(c).to_pylist() for c in ("host", "stream", "wrapper"))):
                own = matched(s, w)
                hosts += [host] * len(own)
                streams += [s] * len(own)
                leaves += range(len(own))
                numbers += own
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(streams, pa.string()), pa.array(leaves, pa.int32()), pa.array(numbers, pa.int32())], ["host", "stream", "leaf", "slot"])

    return unique.join(whole, "host").select("host", "stream", "wrapper").mapInArrow(tidy(run), "host string, stream string, leaf int, slot int")


def contents(seen: DataFrame, numbers: DataFrame) -> DataFrame:
    """(host, stream, content, links): of each distinct stream the text slots that hold content, and those of them that mostly hold links."""
    each = seen.select("host", "stream", "digest", F.posexplode("sizes").alias("leaf", "s")).select("host", "stream", "digest", "leaf", "s.*")
    by_page = each.join(numbers, ["host", "stream", "leaf"])
    # Over a host, a slot of the wrapper holds template text if it never changes while the pages do.
    constant = by_page.groupBy("host", "slot").agg(F.count_distinct("digest").alias("pages"), (F.min("text") == F.max("text")).alias("same"))
    template = constant.where(F.col("same") & (F.col("pages") > 1)).select("host", "slot", F.lit(True).alias("template"))
    sums = each.groupBy("host", "stream", "leaf").agg(F.sum("plain").alias("plain"), F.sum("linked").alias("linked"))
    rows = sums.join(numbers, ["host", "stream", "leaf"]).join(template, ["host", "slot"], "left")
    lists = rows.groupBy("host", "stream").agg(F.array_sort(F.collect_list(F.struct("leaf", "plain", "linked", F.coalesce("template", F.lit(False)).alias("template")))).alias("held"))

    def run(batches):
        for batch in batches:
            out = []
            for s, held in zip(batch.column("stream").to_pylist(), batch.column("held").to_pylist()):
                paths = [p for p, _ in texts_in(parsed(s.split()))]
                out.append(content_slots([(paths[x["leaf"]], x["plain"], x["linked"], x["template"]) for x in held]))
            columns = list(zip(*out)) if out else [[], []]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("stream"), *[pa.array(c, pa.list_(pa.int32())) for c in columns]], ["host", "stream", "content", "links"])

    return lists.mapInArrow(tidy(run), "host string, stream string, content array<int>, links array<int>")


def content_slots(weights: list[tuple[tuple[str, ...], int, int, bool]]) -> tuple[list[int], list[int]]:
    """Of a layout's text slots (path, plain, linked, template), those that hold content, and those of them where blocks of links go."""
    own = [k for k, (p, _, _, _) in enumerate(weights) if not banned(p)]
    inside = lambda k, tag: any(x.partition(".")[0] == tag for x in weights[k][0])
    anchor = next((w for w in ("article", "main") if any(inside(k, w) for k in own)), None)
    if anchor:
        own = [k for k in own if inside(k, anchor)]
    own = [k for k in own if not weights[k][3]] or own
    if anchor:
        return own, []
    where = tuple(region([weights[k][:3] for k in own]))
    own = [k for k in own if weights[k][0][: len(where)] == where]
    return own, [k for k in own if weights[k][1] <= weights[k][2]]


def region(weights: list[tuple[tuple[str, ...], int, int]]) -> list[str]:
    """The path of the deepest element that keeps most plain text."""
    own = [(list(p), a) for p, a, b in weights if a > b]
    total = sum(a for _, a in own)
    if not total:
        return []
    here: list[str] = []
    while True:
        by: dict[str, int] = {}
        for p, a in own:
            if p[: len(here)] == here and len(p) > len(here) and p[len(here)].partition(".")[0] not in ("p", "li", "ul", "ol", "blockquote", "table", "pre", "h1", "h2", "h3"):
                by[p[len(here)]] = by.get(p[len(here)], 0) + a
        best = max(by, key=lambda x: (by[x], x), default=None)
        if best is None or 2 * by[best] < total:
            return here
        here = [*here, best]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every whole page."""
    small_batches(pages.sparkSession)
    url, page_id = F.col("url").cast("string"), F.col("page_id").cast("long")
    rows = pages.where("page_id is not null").select(page_id.alias("page_id"), url.alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host_of(url, page_id).alias("host"))
    seen = stage(page_slots(rows), "slots")
    unique = stage(seen.groupBy("host", "stream").agg(F.count("*").alias("n")), "streams")
    numbers = stage(slot_numbers(unique, stage(wrappers(unique), "wrappers")), "numbers")
    learned = stage(contents(seen, numbers), "contents")
    found = seen.select("page_id", "url", "host", "stream", "texts").join(learned, ["host", "stream"], "left")
    own = F.filter("texts", lambda t: F.array_contains("content", t["leaf"]) & ~(t["link"] & F.array_contains("links", t["leaf"])))
    text = F.coalesce(F.array_join(F.transform(own, lambda t: t["text"]), "\n\n"), F.lit(""))
    return found.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
