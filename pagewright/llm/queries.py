"""The registered queries of this subpackage: thin ``opN_<name>`` callables over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, fingerprint, line_index, matroska, minhash, oracle, packing, prefix_trie, spellings, suffix_dedup, token_store, toxicity, window_index, wrappers
from .common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.dedup(table(spark, sf_dir, "documents"), 100))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited(table(spark, sf_dir, "documents"))


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.read_media(matroska.to_media(table(spark, sf_dir, "documents")))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_store.new_folder(spark)
    token_store.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder, 2)
    return token_store.read(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32", "verified")


def op6_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), 3, 85)


def op7_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op9_window_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_index.digest(window_index.dedup(table(spark, sf_dir, "documents"), 35))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 0.3)


def op11_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.variants(spellings.vocabulary(spellings.words(table(spark, sf_dir, "documents"), 199), 6, 5), 5)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns_of(table(spark, sf_dir, "conversations"))))


def op13_line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_index.digest(line_index.dedup(table(spark, sf_dir, "documents"), 20, 3))


def queries() -> dict:
    return {k: f for k, f in sorted(globals().items(), key=lambda x: (len(x[0].split("_")[0]), x[0])) if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
