"""Incremental indexing: what changed since the manifest, chunk reuse, staleness, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("code", "text", "image")


def diff_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, status): new, unchanged (same time and size), touched (same hash), changed or deleted.

    A full outer join, so the last file of a type that goes is seen as deleted.
    """
    f = files.select("path", F.col("mtime").alias("f_mtime"), F.col("size").alias("f_size"), F.col("hash").alias("f_hash"), F.lit(1).alias("f"))
    m = manifest.select("path", F.col("mtime").alias("m_mtime"), F.col("size").alias("m_size"), F.col("hash").alias("m_hash"), F.lit(1).alias("m"))
    status = (
        F.when(F.col("m").isNull(), "new").when(F.col("f").isNull(), "deleted")
        .when((F.col("f_mtime") == F.col("m_mtime")) & (F.col("f_size") == F.col("m_size")), "unchanged")
        .when(F.col("f_hash") == F.col("m_hash"), "touched").otherwise("changed")
    )
    return f.join(m, "path", "full_outer").select("path", status.alias("status"))


def diff_chunks(new: DataFrame, old: DataFrame) -> DataFrame:
    """(path, chunk_index, status): created, reused (same text hash at the same place) or removed."""
    n = new.select("path", "chunk_index", F.col("text_hash").alias("n_hash"), F.lit(1).alias("n"))
    o = old.select("path", "chunk_index", F.col("text_hash").alias("o_hash"), F.lit(1).alias("o"))
    status = F.when(F.col("n").isNull(), "removed").when(F.col("n_hash") == F.col("o_hash"), "reused").otherwise("created")
    return n.join(o, ["path", "chunk_index"], "full_outer").select("path", "chunk_index", status.alias("status"))


def deleted_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    return manifest.join(files, "path", "left_anti").select("path")


def staleness(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: new, modified (another time) and deleted files, and their sum."""
    f = files.select("path", F.col("mtime").alias("f_mtime"))
    m = manifest.select("path", F.col("mtime").alias("m_mtime"))
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    new, gone = F.col("m_mtime").isNull(), F.col("f_mtime").isNull()
    got = f.join(m, "path", "full_outer").agg(count(new).alias("n_new"), count(~new & ~gone & (F.col("f_mtime") != F.col("m_mtime"))).alias("n_modified"), count(gone).alias("n_deleted"))
    return got.withColumn("n_stale", F.col("n_new") + F.col("n_modified") + F.col("n_deleted"))


def status_rollup(entries: DataFrame) -> DataFrame:
    """(type, files, chunks, bytes) of all three types, zeros included; ``entries`` has type, n_chunks and size."""
    dim = entries.sparkSession.createDataFrame([(t,) for t in TYPES], "type string")
    got = entries.groupBy("type").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chunks").alias("chunks"), F.sum("size").alias("bytes"))
    return dim.join(got, "type", "left").na.fill(0, ["files", "chunks", "bytes"])


def index_stats(file_diff: DataFrame, chunk_diff: DataFrame) -> DataFrame:
    """One row of counters over both differences."""
    n = lambda *s: F.coalesce(F.sum(F.when(F.col("status").isin(*s), 1).otherwise(0)), F.lit(0)).cast("long")
    files = file_diff.agg(n("new", "unchanged", "touched", "changed").alias("files_scanned"), n("new", "changed").alias("files_indexed"), n("unchanged", "touched").alias("files_skipped"))
    chunks = chunk_diff.agg(n("created").alias("chunks_created"), n("reused").alias("chunks_reused"), n("removed").alias("chunks_removed"))
    return files.crossJoin(chunks)  # one row each


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with ``rows`` in place of its rows of the same keys."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def remove(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")
