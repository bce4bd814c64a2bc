"""A training-data pipeline over ``documents``: toxicity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but
the last return the columns of documents.  :func:`run` writes each stage's rows as Parquet to the
folder that the cluster shares and reads them again as the next stage's docs.

A null text counts as empty: it is scored like one, is no near duplicate, has no passages, and is packed as
its end token.  Rows without a doc_id pass the filtering stages (they are scored, but nothing is a duplicate of
them) and aren't packed.  Of rows that share a doc_id, the one with the least text decides for all of them whether
they are near duplicates, and it alone stays from the third stage on.  Ties have no effect: of near duplicates the
least doc_id stays.  Empty tables give empty results at every stage.  Columns beside those of documents are dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import minhash, packing, toxicity, window_index
from pagewright.llm.common import only, stage, table, unstage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Scores from here on are rejected.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (operator 10) doesn't reject."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return docs.select(*COLUMNS).where(toxicity.score_column(model, F.col("text")) < TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (operator 6): five-word shingles, similarity of 0.8 or more."""
    gone = stage(minhash.near_duplicates(docs, 5, 80).where("not kept").select("doc_id"), "gone")
    return only(docs, gone, how="left_anti").select(*COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words under windows of 35 words that occur more than once (operator 9); others, null texts too, stay as they are."""
    marked = docs.withColumn("no_text", F.col("text").isNull())
    cut = window_index.dedup(marked, 35, carry=("text", "lang", "source", "n_chars", "no_text"))
    text, n = F.when(F.col("n_removed") > 0, F.col("kept")).when(~F.col("no_text"), F.col("text")), F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", text.alias("text"), "lang", "source", n.cast("long").alias("n_chars")).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequences (operator 2)."""
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("repeated passages", cut_repeated_passages), ("packing", pack)]
#: SQL can't express a fitted classifier or a tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    before = None
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            unstage(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
