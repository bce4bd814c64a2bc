"""Registered queries over scans: derived layout files by band, id and box, and JSON caches written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import right
from ..functions.kernels import folded
from ..operators.cases import rotating
from ..sources import caches, derived, layout


def band_lines(s: SparkSession, d: str) -> DataFrame:
    """Lines that lie whole between two heights and start in a column, of every page."""
    boxes = layout.boxes_of(derived.files(s, d, "alto"))
    return layout.band(boxes, 80, 400, 50, 150).groupBy("file").agg(F.count("*").alias("lines"), F.min("vpos").alias("top"), F.max(F.col("vpos") + F.col("height")).alias("bottom"), F.sum("width").alias("width"))


def last_texts(s: SparkSession, d: str) -> DataFrame:
    """Corrections by line id, where ten ids are used over and over: the last text of each counts."""
    texts = layout.texts_of(derived.files(s, d, "alto")).withColumn("line_id", F.concat(F.lit("l"), (F.col("line_ord") % 10).cast("string")))
    return layout.corrections(texts).select("file", "line_id", F.md5("text").alias("text"))


def matched_scans(s: SparkSession, d: str) -> DataFrame:
    """Lines to be matched by their boxes, of source files and of truth files."""
    one = lambda kind, truth: layout.matched_of(derived.files(s, d, kind), truth).select(F.lit(kind).alias("kind"), "file", "line_id", "x0", "y0", "x1", "y1", F.md5("text").alias("text"))
    return one("alto", False).unionByName(one("page", True))


def cache_scans(s: SparkSession, d: str) -> DataFrame:
    """Caches of words and of blanks as JSON, one for each file, read back: lines, characters with their places, and blanks."""
    words = caches.engine_words_of(derived.caches(s, d, "words")).select("file", "line_id", F.size("spans").alias("chars"), F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["x1"] - x["x0"]).alias("covered"))
    found = caches.ink_gaps_of(derived.caches(s, d, "gaps")).select("file", "line_id", F.size("gaps").alias("blanks"), F.aggregate("gaps", F.lit(0).cast("bigint"), lambda a, g: a + g["end"] - g["start"]).alias("blank"))
    both = words.join(found, ["file", "line_id"])
    return both.groupBy("file").agg(F.count("*").alias("lines"), F.sum("chars").alias("chars"), F.sum("covered").alias("covered"), F.sum("blanks").alias("blanks"), F.sum("blank").alias("blank"))


def campaign_summary(s: SparkSession, d: str) -> DataFrame:
    """Result files as JSON, one for each language and source, read back: unfinished and undeliverable ones left out."""
    docs = derived.documents(s, d)
    page = F.struct(F.col("doc_id").cast("string").alias("k"), F.struct(F.when(F.col("doc_id") % 9 == 4, "no file came back").alias("error")).alias("v"))
    runs = docs.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(page)).alias("pages"), F.sum("n_chars").alias("tokens_in"), F.count_if(F.col("doc_id") % 3 == 0).alias("changed"), F.min("doc_id").alias("first"))
    name = F.concat(F.when(F.col("first") % 5 == 3, "runs/undeliverable__").otherwise("runs/"), "lang", F.lit("_"), "source")
    body = F.struct(F.when(F.col("first") % 7 != 5, F.col("lang")).alias("corpus"), F.col("source").alias("producer"), (F.col("first") % 4 == 2).alias("partial"), (F.col("tokens_in") / 1000).alias("seconds"), "tokens_in", "changed", "pages")
    out = caches.summary_of(runs.select(name.alias("file"), F.to_json(body).alias("value")))
    return out.select("corpus", "producer", "changed", "tokens_in", F.round("seconds", 6).alias("seconds"), "finished", "failed")


def cut_scans(s: SparkSession, d: str) -> DataFrame:
    """Cut caches as JSON, one for each file, read back; where a span is missing, the line is an error row."""
    return caches.cuts_of(derived.caches(s, d, "cuts")).groupBy("file", "error").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"), F.sum(F.element_at("spans", -1)["x1"]).alias("right_edge"))


def folded_texts(s: SparkSession, d: str) -> DataFrame:
    """Texts in lower case without accents, one character for one."""
    return derived.documents(s, d).where("text is not null").select("doc_id", F.length("text").alias("chars"), F.md5(folded("text")).alias("folded"))


def word_tokens(s: SparkSession, d: str) -> DataFrame:
    """Words by the two rules of text reports: runs of three letters or more, and parts between blanks of more than two characters."""
    low = F.lower("text")
    letters = F.filter(F.regexp_extract_all(low, F.lit(r"\p{L}+"), F.lit(0)), lambda w: F.length(w) >= 3)
    parts = F.filter(F.split(low, r"\s+"), lambda w: F.length(w) > 2)
    rows = derived.documents(s, d).select("lang", letters.alias("a"), parts.alias("b"))
    return rows.groupBy("lang").agg(F.sum(F.size("a")).alias("words"), F.sum(F.size(F.array_distinct("a"))).alias("different"), F.sum(F.size("b")).alias("parts"))


def rotating_sample(s: SparkSession, d: str) -> DataFrame:
    """The words that a campaign joins, twenty lines of a page at most."""
    rows = rotating(derived.lines(s, d), 20)
    a, b = F.element_at("words", F.col("at") + 1), F.element_at("words", F.col("at") + 2)
    return rows.groupBy("file").agg(F.count("*").alias("lines"), F.sum("at").alias("places"), F.sum(right(b) - a["hpos"]).alias("width"), F.max(F.md5(F.concat(a["text"], b["text"]))).alias("top"))


def queries() -> dict:
    return {f.__name__: f for f in (band_lines, last_texts, matched_scans, cache_scans, campaign_summary, cut_scans, folded_texts, word_tokens, rotating_sample)}
