"""Registered queries over returned texts: attachment to lines, guards, and words put back on their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.likeness import likeness_of, unanchored_share_of
from ..operators import attachment, guards, reprojection
from ..sources import derived


def misattached_lines(s: SparkSession, d: str) -> DataFrame:
    """Changed lines that another line's truth fits better than their own by a margin."""
    found = attachment.misattached(derived.returned(s, d))
    return found.select("page", "ord", "other", F.round("own", 6).alias("own"), F.round("score", 6).alias("score"), "wrong")


def margin_veto(s: SparkSession, d: str) -> DataFrame:
    """What the veto by margin makes of every corpus's changed lines, strictly and with twins exempt."""
    lines = derived.returned(s, d)
    corpora, changed = lines.select("page", "corpus").distinct(), attachment.valued(lines, "source", "output")  # for both rules
    one = lambda twin, rule: attachment.margin_veto(lines, twin=twin, changed=changed).join(corpora, "page").groupBy("corpus", "verdict").agg(F.count("*").alias("lines")).withColumn("rule", F.lit(rule))
    return one(None, "strict").unionByName(one(attachment.TWIN, "twins exempt"))


def put_back_control(s: SparkSession, d: str) -> DataFrame:
    """Pages joined to a stream of words and put back uncorrected: every line must come out as it was."""
    pages = reprojection.linearise(derived.hyphenated(s, d)).withColumn("corrected", F.col("owners.word"))
    words = pages.select("page", F.size("owners").alias("words"), F.size(F.filter("owners", lambda o: o["tail_line"] >= 0)).alias("joined"))
    lines = reprojection.put_back(pages).groupBy("page").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"), F.max(F.md5("text")).alias("top"), F.min(F.md5("text")).alias("bottom"))
    return lines.join(words, "page")


def words_put_back(s: SparkSession, d: str) -> DataFrame:
    """Pages corrected by a rule of words (accents on every fifth, one of thirteen left out, one of seventeen doubled by a new
    word) and put back: lines and words by what became of them."""
    pages = reprojection.linearise(derived.hyphenated(s, d))
    word = lambda w, i: F.when(i % 13 == 7, F.array().cast("array<string>")).when(i % 17 == 3, F.array(w, F.lit("inserted"))).when(i % 5 == 0, F.array(F.translate(w, "eao", "éàô"))).otherwise(F.array(w))
    pages = pages.withColumn("corrected", F.flatten(F.transform("owners.word", word)))
    back = reprojection.put_back(pages).join(derived.hyphenated(s, d).withColumnRenamed("text", "before"), ["page", "ord"])
    size = lambda c: F.size(F.filter(F.split(c, " "), lambda w: w != ""))
    return back.groupBy("page").agg(F.count("*").alias("lines"), F.count_if(F.col("text") == F.col("before")).alias("same"), F.sum(size("before")).alias("words_before"), F.sum(size("text")).alias("words"), F.max(F.struct(F.md5("text").alias("top"), "ord")).alias("x")).select("page", "lines", "same", "words_before", "words", "x.top", "x.ord")


def _runs(s: SparkSession, d: str) -> DataFrame:
    """Two producers' results over all lines; the second one's are those of another turn."""
    one = lambda turn, producer: derived.returned(s, d, turn).withColumns({"turn": F.lit(turn), "producer": F.lit(producer)})
    return one(0, "first").unionByName(one(2, "second"))


def guard_report(s: SparkSession, d: str) -> DataFrame:
    rows = guards.guard_report(_runs(s, d))
    return rows.withColumns({c: F.round(c, 6) for c in ("cer", "cer_reverted")})


def correction_counts(s: SparkSession, d: str) -> DataFrame:
    """Results by corpus and producer: lines changed, better and worse, corrections that both producers share, error rates."""
    rows = _runs(s, d).withColumn("before", guards.edits("source", "truth")).withColumn("after", guards.edits("output", "truth"))
    changed = F.col("output") != F.col("source")
    shared = rows.where(changed).groupBy(*guards.KEY).agg(F.countDistinct("producer").alias("producers")).groupBy("corpus").agg(F.count("*").alias("corrections"), F.count_if(F.col("producers") > 1).alias("shared"))
    each = rows.groupBy("corpus", "producer").agg(
        F.count_if(changed).alias("changed"), F.count_if(changed & (F.col("after") < F.col("before"))).alias("better"), F.count_if(changed & (F.col("after") > F.col("before"))).alias("worse"),
        F.round(F.sum("before") / F.sum(F.length("truth")), 6).alias("cer_before"), F.round(F.sum("after") / F.sum(F.length("truth")), 6).alias("cer_after"),
    )
    return each.join(shared, "corpus")


def unanchored_words(s: SparkSession, d: str) -> DataFrame:
    """How many changed lines have words that their source doesn't account for."""
    rows = derived.returned(s, d).where(F.col("output") != F.col("source")).withColumn("share", unanchored_share_of("source", "output"))
    return rows.groupBy("corpus").agg(F.count("*").alias("changed"), F.count_if(F.col("share") > 0).alias("unanchored"), F.round(F.avg("share"), 6).alias("share"), F.round(F.max("share"), 6).alias("most"))


def recourse_report(s: SparkSession, d: str) -> DataFrame:
    """Under sources that read letters wrongly: corrections, right and misplaced ones, that the text alone refuses, and how many of
    each a reading of the line gives back at several thresholds."""
    lines = derived.returned(s, d).withColumn("source", F.when((F.col("page") + F.col("ord")) % 2 == 0, F.translate("truth", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba")).otherwise(F.col("source")))
    changed = lines.where(F.col("output") != F.col("source"))
    verdict = F.when(likeness_of("source", "output") < attachment.LEAST, "unlike").otherwise("like")
    vetoed = changed.withColumn("verdict", verdict)
    readings = lines.where("ord % 10 <> 7").select("page", "ord", F.translate("truth", "ae", "oc").alias("read"))
    rows = guards.recourse(vetoed, readings).where("recourse is not null").withColumn("right", F.col("output") == F.col("truth"))
    given = [F.count_if(F.col("support") >= at).alias(f"at_{round(100 * at)}") for at in (0.5, 0.6, 0.7, 0.85, 0.9)]
    return rows.groupBy("corpus", "right").agg(F.count("*").alias("refused"), F.count_if(F.col("recourse") == "given back").alias("given_back"), F.count_if(F.col("recourse") == "no reading").alias("no_reading"), *given)


def queries() -> dict:
    names = (misattached_lines, margin_veto, put_back_control, words_put_back, guard_report, correction_counts, unanchored_words, recourse_report)
    return {f.__name__: f for f in names}
