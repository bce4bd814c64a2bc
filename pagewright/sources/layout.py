"""Page-layout XML as DataFrames: word boxes of lines, line boxes, and plain line texts.

Files are read by Spark (``binaryFile``), so any store that Spark reads will do, and parsed in
Arrow batches, one file at a time.  Elements are known by their local names, whatever namespace.
"""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = "file string, page_no int, line_ord int, line_id string, hpos bigint, vpos bigint, width bigint, height bigint, words array<struct<text:string,hpos:bigint,width:bigint>>"
BOXES = "file string, ord bigint, line_id string, hpos bigint, vpos bigint, width bigint, height bigint, text string, page_width bigint, page_height bigint"
TEXTS = "file string, line_ord int, line_id string, text string, has_hyphen boolean"


#: Words or lines that are gathered from files before they are turned into columns.
GATHERED = 1 << 16


def parsed(raw: bytes) -> ET.Element:
    """The root of a file, with elements' local names as their tags, whatever namespace they are in."""
    return plain(ET.fromstring(raw))


def plain(root: ET.Element) -> ET.Element:
    if any("}" in tag for tag in {e.tag for e in root.iter()}):
        for element in root.iter():
            element.tag = element.tag.rpartition("}")[2]
    return root


def whole(text: str) -> int | None:
    """A number cut toward zero; None for what isn't one or takes more than 64 bits."""
    try:
        value = int(float(text))
    except (ValueError, OverflowError):
        return None
    return value if abs(value) < 1 << 62 else None


def number(element: ET.Element, name: str) -> int | None:
    return whole(element.get(name, ""))


def points_of(element: ET.Element) -> str:
    coords = element.find("Coords")
    if coords is None:
        return ""
    return coords.get("points") or " ".join(f"{p.get('x')},{p.get('y')}" for p in coords)


def enclosed(points: str) -> tuple[int, int, int, int] | None:
    """(hpos, vpos, width, height) of a polygon; one bad point and it has none."""
    xy = [[whole(v) for v in p.split(",")] for p in points.split()]
    if not xy or any(len(p) < 2 or None in p for p in xy):
        return None
    xs, ys = [p[0] for p in xy], [p[1] for p in xy]
    return min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)


def envelope(element: ET.Element) -> tuple[int, int, int, int] | None:
    return enclosed(points_of(element))


def _rest(texts: list[str], simple: np.ndarray, columns: np.ndarray, one) -> tuple[np.ndarray, np.ndarray]:
    """(columns, known) with what isn't written simply worked out one by one."""
    known = simple.copy()
    for i in np.flatnonzero(~simple).tolist():
        got = one(texts[i]) if texts[i] else None
        if got is not None:
            columns[:, i], known[i] = got, True
    return columns, known


def wholes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, known) of :func:`whole` for many texts at once."""
    column = pa.array(texts, pa.string())
    simple = pc.match_substring_regex(column, r"^-?\d{1,15}$").to_numpy(zero_copy_only=False)
    out = np.zeros((1, len(texts)), np.int64)
    out[0, simple] = column.filter(pa.array(simple)).cast(pa.int64()).to_numpy()
    out, known = _rest(texts, simple, out, whole)
    return out[0], known


def _numbers(column: pa.Array) -> np.ndarray:
    return pc.list_flatten(pc.split_pattern(pc.replace_substring(column, " ", ","), ",")).cast(pa.int64()).to_numpy()


def envelopes(points: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """((hpos, vpos, width, height), known) of :func:`enclosed` for many polygons at once."""
    column = pa.array(points, pa.string())
    simple = pc.match_substring_regex(column, r"^-?\d{1,15},-?\d{1,15}( -?\d{1,15},-?\d{1,15})*$").to_numpy(zero_copy_only=False)
    out, some = np.zeros((4, len(points)), np.int64), column.filter(pa.array(simple))
    if len(some):
        at = np.append(0, np.cumsum(pc.count_substring(some, " ").to_numpy() + 1)[:-1])
        xy = _numbers(some)
        for k in (0, 1):
            low = np.minimum.reduceat(xy[k::2], at)
            out[k, simple], out[k + 2, simple] = low, np.maximum.reduceat(xy[k::2], at) - low
    return _rest(points, simple, out, enclosed)


def spelt(equiv: ET.Element) -> str:
    for u in equiv:
        if u.tag in ("Unicode", "PlainText"):
            return u.text or ""
    return ""


def transcription(element: ET.Element) -> str | None:
    """The text with the least index (then the first); without a number an index counts as very high."""
    equivs = element.findall("TextEquiv")
    if len(equivs) < 2:
        return spelt(equivs[0]) if equivs else None
    index = lambda e: int(e.get("index", "")) if e.get("index", "").isdigit() else 10**9
    return spelt(min(equivs, key=index))


def repaired(text: str) -> str:
    """UTF-8 that was read as Latin-1, read again where the text shows it."""
    if "Ã" in text or "Â" in text:
        try:
            return text.encode("latin-1").decode("utf-8")
        except UnicodeError:
            pass
    return text


def alto_lines(raw: bytes, max_pages: int | None = None) -> Iterator[tuple]:
    """(page, line id, box, words' texts, words' places) of every line as they are written."""
    for line in parsed(raw).iter("TextLine"):
        words = line.findall("String")
        yield 1, line.get("ID"), [line.get(k, "") for k in ("HPOS", "VPOS", "WIDTH", "HEIGHT")], [s.get("CONTENT") for s in words], [(s.get("HPOS", ""), s.get("WIDTH", "")) for s in words]


def page_lines(raw: bytes, max_pages: int | None = None) -> Iterator[tuple]:
    for line in parsed(raw).iter("TextLine"):
        words = line.findall("Word")
        yield 1, line.get("id") or line.get("ID"), points_of(line), [transcription(w) for w in words], [points_of(w) for w in words]


def djvu_lines(raw: bytes, max_pages: int | None = None) -> Iterator[tuple]:
    """Pages are parsed one after another and freed; coordinates are ``x0,y1,x1,y0``."""
    page = 0
    for _, element in ET.iterparse(io.BytesIO(raw)):
        if element.tag.rpartition("}")[2] != "OBJECT":
            continue
        page += 1
        if max_pages is not None and page > max_pages:
            return
        for line in plain(element).iter("LINE"):
            words = line.findall("WORD")
            yield page, None, None, [(w.text or "").strip() for w in words], [w.get("coords", "") for w in words]
        element.clear()


def _alto_places(places: list, boxes: list):
    (x, known), (w, sized) = (wholes([p[k] for p in places]) for k in (0, 1))
    sides = [wholes([b[k] for b in boxes]) for k in range(4)]
    own = sides[0][1] & sides[2][1] & (sides[2][0] > 0)
    return x, w, known & sized, np.stack([np.where(k, v, 0) for v, k in sides]), own, np.ones(len(boxes), bool)


def _page_places(places: list, boxes: list):
    (words, known), (lines, held) = envelopes(places), envelopes(boxes)
    return words[0], words[2], known, lines, held & (lines[2] > 0), held


def _djvu_one(text: str) -> tuple[int, int] | None:
    v = [whole(x) for x in text.split(",")[:4]]
    return None if len(v) < 4 or None in v else (v[0], v[2] - v[0])


def _djvu_places(places: list, boxes: list):
    column = pa.array(places, pa.string())
    simple = pc.match_substring_regex(column, r"^-?\d{1,15}(,-?\d{1,15}){3}$").to_numpy(zero_copy_only=False)
    out, v = np.zeros((2, len(places)), np.int64), _numbers(column.filter(pa.array(simple))).reshape(-1, 4)
    out[0, simple], out[1, simple] = v[:, 0], v[:, 2] - v[:, 0]
    (x, w), known = _rest(places, simple, out, _djvu_one)
    none = np.zeros(len(boxes), bool)
    return x, w, known, np.zeros((4, len(boxes)), np.int64), none, ~none


#: For each kind of file: its lines as written, and from them ``(x, width, known)`` of words, and of lines the box, whether it has a
#: left edge and a width of its own, and whether it may do without.
READERS = {"alto": (alto_lines, _alto_places), "page": (page_lines, _page_places), "djvu": (djvu_lines, _djvu_places)}


def usable_lines(files: list, kind: str, lines: list[tuple], least: int) -> pa.RecordBatch:
    """Rows of ``LINES`` from lines as written and their files' numbers and names: lines whose words are all complete and wider than 0,
    none left of the one before, and enough of them.  Without a box a line takes its words' one."""
    page, key, boxes, texts, places = ([x[k] for x in lines] for k in range(5))
    n = np.array([len(t) for t in texts], np.int64)
    at = np.append(0, np.cumsum(n))
    text = pa.array([t for own in texts for t in own], pa.string())
    x, w, known, box, boxed, allowed = READERS[kind][1]([p for own in places for p in own], boxes)
    empty = pc.fill_null(pc.equal(text, ""), True).to_numpy(zero_copy_only=False)
    bad = empty | ~known | (w <= 0)
    inner = np.ones(len(x), bool)
    inner[at[:-1][n > 0]] = False
    bad[1:] |= inner[1:] & (x[1:] < x[:-1])
    spoilt = np.append(0, np.cumsum(bad))
    good = (spoilt[at[1:]] == spoilt[at[:-1]]) & (n >= max(least, 1)) & allowed
    marked = pc.fill_null(pc.match_substring_regex(text, "[ÃÂ]"), False)
    if kind != "djvu" and pc.any(marked).as_py():
        text = pa.array([repaired(t) if m else t for t, m in zip(text.to_pylist(), marked.to_pylist())], pa.string())
    first, last = at[:-1][good], at[1:][good] - 1
    hpos = np.where(boxed[good], box[0, good], x[first])
    width = np.where(boxed[good], box[2, good], x[last] + w[last] - x[first])
    line_ord, names, keys, before, at_page = [], [], [], None, None
    for i in np.flatnonzero(good).tolist():
        if files[i][0] != before:
            before, nth, on_page, at_page = files[i][0], 0, 0, None
        if page[i] != at_page:
            at_page, on_page = page[i], 0
        names.append(files[i][1])
        line_ord.append(nth)
        nth, on_page = nth + 1, on_page + 1
        keys.append(key[i] or (f"p{at_page}-l{on_page}" if kind == "djvu" else f"line-{nth - 1}"))
    held = np.repeat(good, n)
    words = pa.StructArray.from_arrays([text.filter(pa.array(held)), pa.array(x[held]), pa.array(w[held])], ["text", "hpos", "width"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n[good])).astype(np.int32)), words)
    columns = [pa.array(names, pa.string()), pa.array([page[i] for i in np.flatnonzero(good)], pa.int32()), pa.array(line_ord, pa.int32()), pa.array(keys, pa.string())]
    return pa.RecordBatch.from_arrays([*columns, pa.array(hpos), pa.array(box[1, good]), pa.array(width), pa.array(box[3, good]), lists], ["file", "page_no", "line_ord", "line_id", "hpos", "vpos", "width", "height", "words"])


def box_rows(raw: bytes) -> Iterator[tuple]:
    """(line id, hpos, vpos, width, height, text, page width, page height), lines without words too."""
    root = parsed(raw)
    page = next(root.iter("Page"), None)
    size = [(number(page, a) or number(page, b) or 0) if page is not None else 0 for a, b in (("WIDTH", "imageWidth"), ("HEIGHT", "imageHeight"))]
    for n, line in enumerate(root.iter("TextLine")):
        if line.get("HPOS") is not None:
            box = tuple(number(line, k) or 0 for k in ("HPOS", "VPOS", "WIDTH", "HEIGHT"))
            text = " ".join([s.get("CONTENT", "") for s in line.findall("String")])
        else:
            box = envelope(line)
            text = transcription(line)
            if text is None:
                text = " ".join(filter(None, [transcription(w) for w in line.findall("Word")]))
        if box and box[2] > 0 and box[3] > 0:
            yield line.get("ID") or line.get("id") or f"l{n}", *box, text, *size


def text_rows(raw: bytes) -> Iterator[tuple]:
    """(line id, text, whether a hyphen element ends it), every line, usable or not."""
    for n, line in enumerate(parsed(raw).iter("TextLine")):
        words = [s.get("CONTENT", "") for s in line.findall("String")]
        text = " ".join(words) if words else transcription(line) or " ".join(filter(None, [transcription(w) for w in line.findall("Word")]))
        yield line.get("ID") or line.get("id"), text, line.find("HYP") is not None


def matched_rows(raw: bytes) -> Iterator[tuple]:
    """(line id, x0, y0, x1, y1, words) of lines that have a box and words, to be matched by their boxes: of ALTO strings those with
    content, of PAGE all words by their first transcription."""
    for line in parsed(raw).iter("TextLine"):
        if line.get("HPOS") is not None:
            x, y, w, h = (number(line, k) or 0 for k in ("HPOS", "VPOS", "WIDTH", "HEIGHT"))
            words = [s.get("CONTENT") for s in line.findall("String") if s.get("CONTENT")]
        else:
            x, y, w, h = envelope(line) or (0, 0, 0, 0)
            words = [next((u.text or "" for e in word.findall("TextEquiv") for u in e.findall("Unicode")), "") for word in line.findall("Word")]
        if w > 0 and h > 0 and words:
            yield line.get("ID") or line.get("id"), x, y, x + w, y + h, words


def matched_of(files: DataFrame, truth: bool = False) -> DataFrame:
    """(file, line_id, x0, y0, x1, y1, text), the last line of each id; of ``truth`` files, lines with a blank word or a space inside
    one are left out: their words can't be told apart."""
    rows = _mapped(files, "file string, ord int, line_id string, x0 bigint, y0 bigint, x1 bigint, y1 bigint, words array<string>", lambda raw: ((n, *r) for n, r in enumerate(matched_rows(raw))))
    if truth:
        rows = rows.where(~F.exists("words", lambda w: (w == "") | w.contains(" ")))
    last = F.max_by(F.struct("x0", "y0", "x1", "y1", F.array_join("words", " ").alias("text")), "ord").alias("last")
    return rows.groupBy("file", "line_id").agg(last).select("file", "line_id", "last.*")


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def _mapped(files: DataFrame, schema: str, rows) -> DataFrame:
    """What ``rows`` gives for each file's content, behind the file's name; columns of many lines are made at once."""
    kinds = files.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kinds)

    def run(batches):
        for batch in batches:
            got = []
            for file, raw in zip(batch.column("file"), batch.column("content")):
                name = file.as_py()
                got += [(name, *r) for r in rows(raw.as_py())]
                if len(got) >= GATHERED:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*got), arrow)], schema=arrow)
                    got = []
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*got), arrow)], schema=arrow)

    return files.mapInArrow(run, kinds)


def read_lines(spark: SparkSession, path: str | list[str], kind: str = "alto", min_words: int = 2, max_pages: int | None = None) -> DataFrame:
    """Usable lines with their words; files that aren't XML stop the job."""
    return lines_of(_files(spark, path), kind, min_words, max_pages)


def lines_of(files: DataFrame, kind: str = "alto", min_words: int = 2, max_pages: int | None = None) -> DataFrame:
    """The same of files held in a table: (file, content)."""
    reader = READERS[kind][0]

    def run(batches):
        for batch in batches:
            names, lines, words = [], [], 0
            for i, (file, raw) in enumerate(zip(batch.column("file"), batch.column("content"))):
                own = list(reader(raw.as_py(), max_pages))
                names += [(i, file.as_py())] * len(own)
                lines += own
                words += sum(len(x[3]) for x in own)
                if words >= GATHERED:
                    yield usable_lines(names, kind, lines, min_words)
                    names, lines, words = [], [], 0
            if lines:
                yield usable_lines(names, kind, lines, min_words)

    return files.mapInArrow(run, LINES)


def read_boxes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return boxes_of(_files(spark, path))


def boxes_of(files: DataFrame) -> DataFrame:
    return _mapped(files, BOXES, lambda raw: ((n, *r) for n, r in enumerate(box_rows(raw))))


def read_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return texts_of(_files(spark, path))


def texts_of(files: DataFrame) -> DataFrame:
    return _mapped(files, TEXTS, lambda raw: ((n, *r) for n, r in enumerate(text_rows(raw))))


def band(boxes: DataFrame, top: int, bottom: int, x0: int, x1: int) -> DataFrame:
    """Lines that lie whole between top and bottom and start in [x0, x1)."""
    return boxes.where((F.col("vpos") >= top) & (F.col("vpos") + F.col("height") <= bottom) & (F.col("hpos") >= x0) & (F.col("hpos") < x1))


def corrections(texts: DataFrame) -> DataFrame:
    """The last text of each line id."""
    return texts.where("line_id is not null").groupBy("file", "line_id").agg(F.max_by("text", "line_ord").alias("text"))


def paired(spark: SparkSession, left: str, right: str) -> DataFrame:
    """Files of two folders that share a name without its endings."""
    stem = lambda c: F.regexp_extract(c, r"([^/]+?)(\.[^/.]+)*$", 1)
    a, b = (spark.read.format("binaryFile").load(p).select(stem(F.col("path")).alias("name"), F.col("path").alias(n)) for p, n in ((left, "left_file"), (right, "right_file")))
    return a.join(b, "name")


