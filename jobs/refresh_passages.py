"""Keeps a table of search passages up to date as files of documents arrive.

A search index is built over passages, cut at paragraph borders. This job
follows a folder (or file, or glob) of Parquet files with doc_id, text and source
by Spark's file stream: each run takes the files that its checkpoint hasn't
seen, in batches, and ends. A document that comes again with another text gets
new passages, one that comes again unchanged gets none.

Output, all of it partitioned Parquet:

* ``versions``, by batch: doc_id, doc_hash, modified (the file's time), source;
* ``passages``, by batch and source: doc_id, doc_hash, chunk_index, passage,
  n_chars, n_tokens (keyword tokens), text_hash. Passages belong to a document's
  text, not to its version: a text that a document had before isn't cut again.

``current`` reads what counts: of each document the version of the newest file
(the greater hash where times are equal), whatever the order in which files
came. A batch writes its own partitions alone and compares itself with earlier
batches alone, so one that failed half-way and comes again replaces what it
left. It costs what is new, plus one read of the ids and hashes in ``versions``.
"""

from __future__ import annotations

import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, command_line, read_config
from skerry.functions import text as T
from skerry.plans.indexing import PASSAGES_SQL
from skerry.plans.search import TOKEN_SQL
from skerry.sources.shared import new_dir

DEFAULTS = {"line_paragraphs": True, "most_chars": T.MAX_CHUNK_CHARS, "least_chars": T.MIN_CHUNK_CHARS, "files_a_batch": 200}
VERSIONS = "doc_id long, doc_hash string, modified timestamp, source string, batch long"
PASSAGES = "doc_id long, doc_hash string, chunk_index int, passage string, n_chars int, n_tokens int, text_hash string, batch long, source string"


def _table(spark: SparkSession, output: str, name: str, schema: str, by: list[str]) -> DataFrame:
    """A table of the output; made empty where it isn't there, so that it can be read before anything came."""
    path = f"{output}/{name}"
    spark.createDataFrame([], schema).write.mode("append").partitionBy(*by).parquet(path)
    return spark.read.schema(schema).parquet(path)


def _write(df: DataFrame, number: int, path: str, by: list[str]) -> int:
    """Replaces a batch's partitions; gives the number of its rows."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).filter(F.col("batch") == number).count()


def cut_passages(docs: DataFrame, settings: dict) -> DataFrame:
    """The passages of (doc_id, doc_hash, text, source, batch); a text without any gets none."""
    text = F.regexp_replace("text", "\n", "\n\n") if settings["line_paragraphs"] else F.col("text")
    each = F.posexplode(T.paragraph_chunks(text, settings["most_chars"], settings["least_chars"])).alias("chunk_index", "passage")
    got = docs.select("doc_id", "doc_hash", each, "batch", "source")
    return got.select(
        "doc_id", "doc_hash", "chunk_index", "passage", F.length("passage").alias("n_chars"), F.size(T.code_tokens(F.col("passage"))).alias("n_tokens"), T.content_hash(F.col("passage")).alias("text_hash"), "batch", "source"
    )


def apply_batch(batch: DataFrame, number: int, output: str, settings: dict) -> dict:
    """Takes one batch (doc_id, text, source, modified) into the output; gives and logs the counts of what it read and wrote."""
    spark = batch.sparkSession
    earlier = spark.read.schema(VERSIONS).parquet(f"{output}/versions").filter(F.col("batch") < number)
    read = batch.agg(F.count(F.lit(1)).alias("rows"), F.count("doc_id").alias("with_id")).first()
    rows = batch.filter("doc_id is not null").select("doc_id", "modified", T.content_hash(F.coalesce("text", F.lit(""))).alias("doc_hash"), "source", F.coalesce("text", F.lit("")).alias("text"))
    # the aggregation keeps one row of a document where it is read, so a document that comes often isn't gathered
    newest = rows.groupBy("doc_id").agg(F.max(F.struct("modified", "doc_hash", "source", "text")).alias("v")).select("doc_id", "v.*", F.lit(number).cast("long").alias("batch")).persist()
    try:
        todo = newest.join(earlier.select("doc_id", "doc_hash").distinct(), ["doc_id", "doc_hash"], "left_anti")
        # equal sources meet in few files, and a large source still goes to many tasks
        passages = _write(cut_passages(todo, settings).hint("rebalance", "source"), number, f"{output}/passages", ["batch", "source"])
        versions = _write(newest.drop("text"), number, f"{output}/versions", ["batch"])
    finally:
        newest.unpersist()
    got = {"batch": number, "rows_read": read["rows"], "rows_without_id": read["rows"] - read["with_id"], "documents": versions, "passages_written": passages}
    LOG.info("refresh_passages: %s", " ".join(f"{k}={v}" for k, v in got.items()))
    return got


def run(spark: SparkSession, input: str, output: str, checkpoint: str, settings: dict | None = None) -> list[dict]:
    """Takes all files that are new since the last run; gives the counts of its batches (none where nothing is new).

    Null and empty texts are documents without passages. Rows without an id are
    no documents: they are counted and left out. Of repeated rows of a document
    one counts, by time and hash; an empty source reads back as null, as
    partitions have it; very long texts are cut whole; further columns are left
    out; an empty table makes empty tables.
    """
    settings = {**DEFAULTS, **(settings or {})}
    for name, schema, by in (("versions", VERSIONS, ["batch"]), ("passages", PASSAGES, ["batch", "source"])):
        _table(spark, output, name, schema, by)
    # a glob, as the stream would take a path without one for a folder
    glob = input if any(c in input for c in "*?[{") else f"{input[:-1]}[{input[-1]}]"
    schema = spark.read.parquet(input).select("doc_id", "text", "source").schema
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", settings["files_a_batch"]).parquet(glob)
    files = files.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", F.col("_metadata.file_modification_time").alias("modified"))
    done: list[dict] = []
    stream = files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: done.append(apply_batch(df, n, output, settings))).start()
    stream.awaitTermination()
    LOG.info("refresh_passages: %s batches from %s into %s", len(done), input, output)
    return done


def current(spark: SparkSession, output: str) -> DataFrame:
    """(doc_id, source, chunk_index, passage, n_chars, n_tokens, text_hash) of the newest version of each document."""
    versions = spark.read.schema(VERSIONS).parquet(f"{output}/versions")
    newest = versions.groupBy("doc_id").agg(F.max(F.struct("modified", "doc_hash", "source")).alias("v")).select("doc_id", "v.doc_hash", "v.source")
    passages = spark.read.schema(PASSAGES).parquet(f"{output}/passages").drop("source", "batch")
    return newest.join(passages, ["doc_id", "doc_hash"]).select("doc_id", "source", "chunk_index", "passage", "n_chars", "n_tokens", "text_hash")


def job1_refresh_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over ``documents`` into one new folder; the second finds nothing new."""
    to = new_dir(spark, "job1")
    for _ in range(2):
        run(spark, f"{sf_dir}/documents.parquet", f"{to}/out", f"{to}/checkpoint")
    return current(spark, f"{to}/out")


JOB1_SQL = f"""
WITH {PASSAGES_SQL}, cut AS (SELECT doc_id, unnest(c) AS passage, generate_subscripts(c, 1) - 1 AS chunk_index FROM kept)
SELECT doc_id, nullif(source, '') AS source, chunk_index::INT AS chunk_index, passage, length(passage)::INT AS n_chars, len({TOKEN_SQL.format(t="passage")})::INT AS n_tokens,
  substr(sha256(passage), 1, 16) AS text_hash FROM cut JOIN documents USING (doc_id)"""


if __name__ == "__main__":

    def _work(spark: SparkSession, at: dict, config: str | None) -> None:
        run(spark, at["input"], at["output"], at["checkpoint"], read_config(spark, config, DEFAULTS) if config else None)

    sys.exit(command_line("refresh_passages", __doc__.split("\n")[0], ("input", "output", "checkpoint"), _work))
