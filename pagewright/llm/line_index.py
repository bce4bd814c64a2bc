"""Operator 13: line dedup with levelled sorted runs of line hashes.

A line's key is the line without white space at its ends, A-Z lower-cased; keys of ``least_chars`` code points count, by the
MD5 of the key.  The index keeps sorted immutable runs of (key, n documents, owner: the largest doc_id that holds it):
bucketed tables, so runs meet in a merge join without a shuffle.  A batch of documents is aggregated to a run; a merge
anti-join with each earlier run takes out of it the keys that are settled there (enough documents, and an owner that this
batch can't change), and what is left is added at level 0.  When a level holds ``FAN`` runs, they are merged into one of the
next level, so a key is rewritten once a level.  Batches go from large to small doc_ids, so common lines are settled early
and later batches add only what is new; any other order gives the same result.  A manifest in the index's folder names the
runs, and a later job can open it and go on: then lines count across jobs, and a line that an earlier batch owns goes from
all new documents with smaller ids.

A key with ``least_docs`` documents loses its lines in every document but the owner's.  Each row is a document; rows that
share a doc_id count one by one, and if it is the largest that holds a key, all of them keep it.  Null ids are below all
others; a null text is one empty line.  An empty table gives no rows.  Columns other than doc_id and text aren't looked at.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import partitions, removed, scratch, small_batches, stage, tidy, unstage, with_hot_keys

LEAST_CHARS, LEAST_DOCS, BATCHES, FAN = 20, 3, 4, 2
SPACE = " \t\n\x0b\x0c\r"
_SPACE = SPACE.encode()
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The key's MD5 in hexadecimal letters; only lines with capitals are lower-cased."""
    bare = F.btrim(line, F.lit(SPACE))
    low = F.when(bare.rlike("[A-Z]"), F.translate(bare, _UPPER, _UPPER.lower())).otherwise(bare)
    return F.md5(low)


def keys_of(text: Column, least_chars: int) -> Column:
    """Distinct keys of a text's lines that are long enough, as hexadecimal letters."""
    long = F.filter(F.split(text, "\n"), lambda x: (F.length(x) >= least_chars) & (F.length(F.btrim(x, F.lit(SPACE))) >= least_chars))
    return F.array_distinct(F.transform(long, line_key))


class LineIndex:
    """Levels of sorted runs (key binary, n, owner) in a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, folder: str | None = None, least_docs: int = LEAST_DOCS):
        """A new index, or with the folder of an earlier one that index, as its last manifest has it."""
        self.spark, self.least_docs = spark, least_docs
        self.folder = folder or f"{scratch(spark)}/line-index-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.manifest = 0
        self._open()

    def _files(self, below: str = "") -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder + below)
        files = at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []

    def _open(self) -> None:
        found = [int(name.removeprefix("manifest-")) for name in self._files() if name.startswith("manifest-")]
        # A manifest counts once its job has ended, which writes the mark of success last.
        number = max((n for n in found if "_SUCCESS" in self._files(f"/manifest-{n}")), default=0)
        if not number:
            return
        self.manifest = number
        for row in self.spark.read.parquet(f"{self.folder}/manifest-{number}").orderBy("level", "place").collect():  # one row a run
            while len(self.levels) <= row["level"]:
                self.levels.append([])
            self.levels[row["level"]].append(row["name"])
            if not self.spark.catalog.tableExists(row["name"]):
                self.spark.sql(f"CREATE TABLE {row['name']} (key BINARY, n BIGINT, owner BIGINT) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {row['buckets']} BUCKETS LOCATION '{self.folder}/{row['name']}'")

    def commit(self) -> None:
        """Write a manifest that names the present runs; what a former one named alone is deleted after it."""
        rows = [(level, place, name, self._buckets(name)) for level, names in enumerate(self.levels) for place, name in enumerate(names)]
        self.manifest += 1
        self.spark.createDataFrame(rows, "level int, place int, name string, buckets int").coalesce(1).write.parquet(f"{self.folder}/manifest-{self.manifest}")
        if self.manifest > 1:
            removed(self.spark, f"{self.folder}/manifest-{self.manifest - 1}")
        named = {row[2] for row in rows}
        for name in self._files():
            if name.startswith("pagewright_lines_") and name not in named:
                self._drop(name)

    def _buckets(self, name: str) -> int:
        return int(name.rsplit("_", 1)[1])

    def _write(self, rows: DataFrame) -> str:
        buckets = partitions(self.spark)
        name = f"pagewright_lines_{uuid.uuid4().hex}_{buckets}"
        rows.select("key", "n", "owner").write.bucketBy(buckets, "key").sortBy("key").option("path", f"{self.folder}/{name}").option("compression", "zstd").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        removed(self.spark, f"{self.folder}/{name}")

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, keys: DataFrame) -> None:
        """One more batch of (key, doc_id) rows, one for each key of a document."""
        new = keys.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("owner"))
        for name in self.runs():
            old = self.spark.table(name).where(F.col("n") >= self.least_docs).select(F.col("key").alias("settled"), F.col("owner").alias("by"))
            new = new.join(old, (F.col("key") == F.col("settled")) & (F.coalesce(F.col("by") >= F.col("owner"), F.col("owner").isNull())), "left_anti")
        self._push(0, self._write(new))
        self.commit()

    def _push(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= FAN:
            full, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._write(self._merged(full)))

    def _merged(self, names: list[str]) -> DataFrame:
        # Read as plain files: a union of bucketed tables must not pass for bucketed.
        rows = self.spark.read.schema("key binary, n bigint, owner bigint").parquet(*[f"{self.folder}/{name}" for name in names])
        return rows.groupBy("key").agg(F.sum("n").alias("n"), F.max("owner").alias("owner"))

    def common(self) -> DataFrame:
        """(key, n, owner) of the keys that enough documents hold; n is counted until a key is settled."""
        names = self.runs()
        if len(names) == 1:
            return self.spark.table(names[0]).where(F.col("n") >= self.least_docs)
        return self._merged(names).where(F.col("n") >= self.least_docs)

    def delete(self) -> None:
        for name in self.runs():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = []
        removed(self.spark, self.folder)


def _batches(rows: DataFrame, batches: int) -> Column:
    """The number of a row's batch, from large to small ids; null ids are in the last."""
    cuts = rows.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).head()[0] or []
    return sum((F.coalesce(F.col("doc_id") <= c, F.lit(True)).cast("int") for c in cuts), F.lit(0))


def dedup(documents: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, folder: str | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept, the text without the dropped lines, for every row.  With a ``folder`` the index
    stays there, and is gone on with if there is one."""
    spark = documents.sparkSession
    small_batches(spark)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("content", F.xxhash64("text"))
    index = LineIndex(spark, folder, least_docs)
    try:
        each = rows.select("doc_id", "content", F.explode(keys_of(F.col("text"), least_chars)).alias("key"), _batches(rows, batches).alias("batch"))
        keys = _staged_by_batch(each.withColumn("key", F.unhex("key")))
        for k in range(batches):
            index.add(keys.where(F.col("batch") == k).select("key", "doc_id"))
        hot = stage(keys.groupBy("key").count().where(F.col("count") > common.HOT).select("key"), "hot-lines")
        # One row for each (document, key) that goes; rows of equal id and text share it.
        lost = with_hot_keys(keys.select("key", "doc_id", "content"), index.common().select("key", "owner"), "key", hot)
        lost = lost.where("owner is not null and not (doc_id <=> owner)").groupBy("doc_id", "content").agg(F.collect_set("key").alias("lost"))  # bounded by the document
        lost = stage(lost.select(F.col("doc_id").alias("of"), F.col("content").alias("same"), "lost"), "lost-lines")
    finally:
        if folder is None:
            index.delete()
    unstage(keys, hot)
    both = rows.join(lost, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("content") == F.col("same")), "left")
    return both.select("doc_id", "text", "lost").mapInArrow(tidy(_kept), "doc_id long, n_lines long, n_dropped long, kept string")


def _kept(batches):
    for batch in batches:
        n_lines, n_dropped, kept = [], [], []
        for text, lost in zip(batch.column("text"), batch.column("lost")):
            lines = text.as_buffer().to_pybytes().split(b"\n")
            n_lines.append(len(lines))
            if lost.is_valid:
                gone = set(lost.as_py())
                lines = [x for x in lines if hashlib.md5(x.strip(_SPACE).lower()).digest() not in gone]
            n_dropped.append(n_lines[-1] - len(lines))
            kept.append(b"\n".join(lines).decode() if lost.is_valid else text.as_py())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])


def _staged_by_batch(rows: DataFrame) -> DataFrame:
    """Staged with a folder for each batch, so that a batch reads only its own rows."""
    spark = rows.sparkSession
    path = f"{scratch(spark)}/line-keys-{uuid.uuid4().hex}"
    rows.write.partitionBy("batch").option("compression", "zstd").parquet(path)
    back = spark.read.schema(rows.schema).parquet(path)
    back._staged_at = path
    return back


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
