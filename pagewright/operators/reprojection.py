"""Corrected pages put back on their lines, word by word.

A page's lines meet in one row: its text is one document's, and the alignment is between the page and its correction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rejoin import linearised_of, put_back_of


def linearise(lines: DataFrame) -> DataFrame:
    """(page, ords, owners) from lines (page, ord, text, hyphened): the page's words in order of ord, broken ones joined, with
    the places of the lines they come from.  Null texts are empty lines."""
    row = F.struct("ord", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("hyphened", F.lit(False)).alias("hyphened"))
    pages = lines.groupBy("page").agg(F.array_sort(F.collect_list(row)).alias("rows"))  # bounded by the page
    return pages.select("page", F.col("rows.ord").alias("ords"), linearised_of("rows.text", "rows.hyphened").alias("owners"))


def put_back(pages: DataFrame) -> DataFrame:
    """(page, ord, text) of every line, from linearised pages with their ``corrected`` words (null: none); a broken word's head gets
    its visible hyphen back, a mark beside the text stays one."""
    texts = pages.select("page", "ords", put_back_of(F.coalesce("corrected", F.array().cast("array<string>")), "owners", F.size("ords")).alias("texts"))
    return texts.select("page", F.explode(F.arrays_zip(F.col("ords").alias("ord"), F.col("texts").alias("text"))).alias("x")).select("page", "x.ord", "x.text")
