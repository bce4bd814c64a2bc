"""JSON caches that other programs leave behind: cuts, ink gaps, word boxes, manifests and campaign results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import word_spans

CUTS = "provenance struct<schema:int,alto:struct<sha256:string>,image:struct<sha256:string>,scale:double,units:string>, lines map<string,struct<text:string,spans:array<array<bigint>>>>"
GAPS = "lines map<string,array<array<bigint>>>"
WORDS = "lines map<string,struct<text:string,boxes:array<array<bigint>>>>"
MANIFEST = "root string, corpora map<string,array<struct<alto:string,cuts:string>>>"
RESULTS = "corpus string, producer string, partial boolean, pages map<string,struct<texts:map<string,array<string>>>>"


def _raw(spark: SparkSession, path) -> DataFrame:
    """(file, value): whole files as text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")


def parsed(raw: DataFrame, schema: str) -> DataFrame:
    """The fields of JSON texts (file, value), held in files or in a table."""
    return raw.select("file", F.from_json("value", schema).alias("x")).select("file", "x.*")


def _json(spark: SparkSession, path, schema: str) -> DataFrame:
    return parsed(_raw(spark, path), schema)


def cuts(spark: SparkSession, path) -> DataFrame:
    return cuts_of(_raw(spark, path))


def cuts_of(raw: DataFrame) -> DataFrame:
    """(file, line_id, text, spans, error): character spans; a text whose length differs from its spans is an error row."""
    rows = parsed(raw, CUTS).select("file", F.explode("lines").alias("line_id", "c"))
    spans = F.transform("c.spans", lambda s: F.struct(s[0].alias("x0"), s[1].alias("x1")))
    return rows.select("file", "line_id", "c.text", spans.alias("spans"), F.when(F.length("c.text") != F.size("c.spans"), "text and spans differ").alias("error"))


def ink_gaps(spark: SparkSession, path) -> DataFrame:
    return ink_gaps_of(_raw(spark, path))


def ink_gaps_of(raw: DataFrame) -> DataFrame:
    rows = parsed(raw, GAPS).select("file", F.explode("lines").alias("line_id", "g"))
    return rows.select("file", "line_id", F.transform("g", lambda s: F.struct(s[0].alias("start"), s[1].alias("end"))).alias("gaps"))


def engine_words(spark: SparkSession, path) -> DataFrame:
    return engine_words_of(_raw(spark, path))


def engine_words_of(raw: DataFrame) -> DataFrame:
    """(file, line_id, text, spans): an engine's word boxes shared evenly among each word's characters; lines with an
    empty word or more words than boxes are left out."""
    rows = parsed(raw, WORDS).select("file", F.explode("lines").alias("line_id", "c"))
    words = F.split("c.text", " ")
    # The rule is asked of texts and boxes, not of what is made of them, so spans are made once.
    whole = rows.where((F.size("c.boxes") >= F.size(words)) & ~F.exists(words, lambda w: w == ""))
    return whole.select("file", "line_id", "c.text", word_spans(words, F.col("c.boxes")).alias("spans"))


def manifest(spark: SparkSession, path, home: str | None = None) -> DataFrame:
    """(corpus, ord, alto, cuts) with the root put before relative paths; a root that begins with ``~`` lies below ``home``."""
    rows = _json(spark, path, MANIFEST).select("root", F.explode("corpora").alias("corpus", "pairs")).select("root", "corpus", F.posexplode("pairs").alias("ord", "p"))
    below = lambda c: F.when(c.rlike("^~(/|$)"), F.concat(F.lit(home.rstrip("/")), F.substr(c, F.lit(2)))).otherwise(c) if home else c
    root = below(F.col("root"))
    full = lambda c: F.when(F.col(c).rlike("^[/~]") | root.isNull(), below(F.col(c))).otherwise(F.concat_ws("/", root, c))
    return rows.select("corpus", "ord", full("p.alto").alias("alto"), full("p.cuts").alias("cuts"))


def digests(spark: SparkSession, paths) -> DataFrame:
    """(path, name, sha256) of whole files."""
    return spark.read.format("binaryFile").load(paths).select("path", F.substring_index("path", "/", -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def recorded(spark: SparkSession, path) -> DataFrame:
    """(cache, layout_digest, image_digest): what each cache says it was made from, for :func:`campaign.paired`."""
    return _json(spark, path, CUTS).select(F.col("file").alias("cache"), F.col("provenance.alto.sha256").alias("layout_digest"), F.col("provenance.image.sha256").alias("image_digest"))


def provenance(pairs: DataFrame, digests: DataFrame, units: str = "layout coordinates (image pixels / scale)") -> DataFrame:
    """Adds ``provenance``, what a cache writer records, to pairs (layout, image, model, scale, image_width, image_height) of
    file names: names and digests of the files, null for files that aren't there, and how coordinates were scaled."""
    rows = pairs
    for kind in ("layout", "image", "model"):
        rows = rows.join(digests.select(F.col("name").alias(kind), F.col("sha256").alias(f"{kind}_sha256")), kind, "left")
    file = lambda kind, *more: F.struct(F.col(kind).alias("name"), F.col(f"{kind}_sha256").alias("sha256"), *more)
    block = F.struct(F.lit(2).alias("schema"), file("layout").alias("alto"), file("image", F.col("image_width").alias("width"), F.col("image_height").alias("height")).alias("image"), file("model").alias("model"), "scale", F.lit(units).alias("units"))
    return rows.withColumn("provenance", block).drop("layout_sha256", "image_sha256", "model_sha256")


def tsv_words(spark: SparkSession, path, scale: float = 1.0) -> DataFrame:
    """Word boxes from an engine's table: unquoted, blanks and negative confidences left out."""
    schema = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left double, top double, width double, height double, conf double, text string"
    rows = spark.read.csv(path, sep="\t", header=True, quote="", schema=schema).where("conf >= 0 and trim(text) != ''")
    return rows.select("text", *[(F.col(c) / scale).alias(c) for c in ("left", "top", "width", "height")])


def finished(raw: DataFrame) -> DataFrame:
    """Result files without those that only dump what couldn't be delivered."""
    return raw.where(~F.col("file").rlike(r"(^|/)(undeliverable|sak_run)[^/]*$"))


def results(spark: SparkSession, path) -> DataFrame:
    return results_of(_raw(spark, path))


def results_of(raw: DataFrame) -> DataFrame:
    """(file, corpus, producer, page, line_id, source, output, truth, kind) of campaign results; partial runs are left out."""
    rows = parsed(finished(raw), RESULTS).where("not coalesce(partial, false)")
    pages = rows.select("file", "corpus", "producer", F.explode("pages").alias("page", "p"))
    each = pages.select("file", "corpus", "producer", "page", F.explode("p.texts").alias("line_id", "t"))
    return each.select("file", "corpus", "producer", "page", "line_id", *[F.get("t", i).alias(n) for i, n in enumerate(("source", "output", "truth", "kind"))])


SUMMARY = "corpus string, producer string, max_side int, prompt string, model string, partial boolean, cer_src double, cer_out double, changed bigint, better bigint, worse bigint, unanchored bigint, wrong bigint, retries bigint, fb_chunks bigint, tokens_in bigint, tokens_out bigint, seconds double, pages map<string,struct<error:string>>"


def summary_of(raw: DataFrame) -> DataFrame:
    """One row for each finished run (file, value): its own totals, and how many of its pages it finished and failed."""
    rows = parsed(finished(raw), SUMMARY).where("not coalesce(partial, false) and corpus is not null")
    failed = F.size(F.filter(F.map_values("pages"), lambda p: p["error"].isNotNull()))
    return rows.withColumn("failed", failed).withColumn("finished", F.size("pages") - F.col("failed")).drop("pages", "partial")
