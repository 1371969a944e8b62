"""The engine's inputs as they follow from the driver's tables, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions.text import content_hash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals few large input splits to all cores, for work that costs far more than moving the rows.

    Inputs with a split for every core, as all large ones have, stay as they are.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file: path by source, id and a language's extension, size, time and hash."""
    ext = F.create_map(*[F.lit(x) for pair in (("en", ".ts"), ("de", ".md"), ("fr", ".png"), ("es", ".xyz")) for x in pair])
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", "text", F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.coalesce(ext[F.col("lang")], F.lit(".txt"))).alias("path"),
        F.col("n_chars").alias("size"), (F.lit(1700000000000) + F.col("doc_id")).alias("mtime"), content_hash(F.col("text")).alias("hash"),
    )


FILES_SQL = """
files AS (SELECT doc_id, text, source || '/doc_' || doc_id || CASE lang WHEN 'en' THEN '.ts' WHEN 'de' THEN '.md' WHEN 'fr' THEN '.png' WHEN 'es' THEN '.xyz' ELSE '.txt' END AS path,
  n_chars AS size, 1700000000000 + doc_id AS mtime, substr(sha256(text), 1, 16) AS hash FROM documents)"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier state: the labelled documents, touched where quality is 0, changed where toxic is 1."""
    labels = table(spark, sf_dir, "labels")
    f = files(spark, sf_dir).join(labels, "doc_id")
    moved = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return f.select(
        "doc_id", "path", "text", "size", F.when(moved, F.col("mtime") - 1).otherwise(F.col("mtime")).alias("mtime"),
        F.when(F.col("toxic") == 1, F.reverse("hash")).otherwise(F.col("hash")).alias("hash"),
    )


MANIFEST_SQL = """
manifest AS (SELECT f.doc_id, f.path, f.text, f.size, CASE WHEN quality = 0 OR toxic = 1 THEN f.mtime - 1 ELSE f.mtime END AS mtime,
  CASE WHEN toxic = 1 THEN reverse(f.hash) ELSE f.hash END AS hash FROM files f JOIN labels USING (doc_id))"""


def present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state now: all files but the French, which are gone."""
    return files(spark, sf_dir).filter(~F.col("path").endswith(".png"))


PRESENT_SQL = "present AS (SELECT * FROM files WHERE NOT ends_with(path, '.png'))"
