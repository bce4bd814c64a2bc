"""Requests joined with the caches of their own files, pair by pair: a manifest says which cache goes with which file.

Line names are unique only inside a file, so a cache that belongs elsewhere gives plausible places on the wrong page.  Every
pair is therefore held to the digests that its cache recorded, a refusal is a row with its reason, and no join can multiply
requests: what occurs twice is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a pair can be used with; the second only if provenance isn't required.
CHECKED, UNCHECKED = "checked", "unchecked"


def _counted(frame: DataFrame, *keys: str) -> DataFrame:
    """One row for each key, of repeated ones any, with ``times``."""
    others = [c for c in frame.columns if c not in keys]
    return frame.groupBy(*keys).agg(F.count("*").alias("times"), *[F.max(c).alias(c) for c in others])


def paired(manifest: DataFrame, caches: DataFrame, sources: DataFrame, require_provenance: bool = True) -> DataFrame:
    """(corpus, file, cache, status), one row for each file of a corpus in the manifest (corpus, file, cache).

    Caches are rows (cache, layout_digest, image_digest) of what they were made from, null where they don't say; sources are
    rows (file, layout_digest, image_digest) of what there is, null where a digest isn't to be checked.  The status is the first
    that applies: ``repeated file``, ``shared cache`` (of several files), ``missing cache``, ``repeated cache``, ``missing source``,
    ``repeated source``, ``no provenance`` (``unchecked`` if it isn't required), ``layout differs``, ``image differs``, ``checked``."""
    pairs = _counted(manifest.select("corpus", "file", "cache"), "corpus", "file").withColumnRenamed("times", "in_manifest")
    users = manifest.select("cache", "corpus", "file").distinct().groupBy("cache").agg(F.count("*").alias("users"))
    held = _counted(caches.select("cache", F.col("layout_digest").alias("made_from"), F.col("image_digest").alias("made_with")), "cache").withColumnRenamed("times", "caches")
    known = _counted(sources.select("file", "layout_digest", "image_digest"), "file").withColumnRenamed("times", "sources")
    rows = pairs.join(users, "cache", "left").join(held, "cache", "left").join(known, "file", "left")
    differs = lambda recorded, actual: F.col(actual).isNotNull() & ~F.col(recorded).eqNullSafe(F.col(actual))
    status = (
        F.when(F.col("in_manifest") > 1, "repeated file").when(F.col("users") > 1, "shared cache").when(F.col("caches").isNull(), "missing cache").when(F.col("caches") > 1, "repeated cache")
        .when(F.col("sources").isNull(), "missing source").when(F.col("sources") > 1, "repeated source")
        .when(F.col("made_from").isNull() & F.col("made_with").isNull(), "no provenance" if require_provenance else UNCHECKED)
        .when(differs("made_from", "layout_digest"), "layout differs").when(differs("made_with", "image_digest"), "image differs").otherwise(CHECKED)
    )
    return rows.select("corpus", "file", "cache", status.alias("status"))


def usable(status: str = "status"):
    return F.col(status).isin(CHECKED, UNCHECKED)


def with_cache(requests: DataFrame, pairs: DataFrame, entries: DataFrame, line: str = "line_ord") -> DataFrame:
    """Requests (corpus, file, line, ...) with the columns of their own cache's entry (cache, line, ...) and the ``pair`` they
    came through: its status, or ``no pair``.  Entries are null where the pair can't be used or the cache lacks the line."""
    good = pairs.where(usable()).select("cache", "corpus", "file")
    own = entries.join(good, "cache").drop("cache")
    return requests.join(pairs.select("corpus", "file", F.col("status").alias("pair")), ["corpus", "file"], "left").fillna("no pair", ["pair"]).join(own, ["corpus", "file", line], "left")
