"""Postings kept up to date from a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skerry.operators import lexical
from skerry.sources.store import Deltas

SCHEMA = "doc_id long, term string, tf long"


def _postings(spark: SparkSession, folder: str) -> Deltas:
    return Deltas(spark, folder, {"postings": SCHEMA}, "doc_id")


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The postings after the last batch that was applied whole."""
    return _postings(spark, folder).load("postings")


def apply_delta(spark: SparkSession, folder: str, batch: DataFrame, version: int) -> None:
    """Upserts a batch (doc_id, text, deleted, seq); of several rows of a document the last by ``seq`` counts.

    The batch's own postings are written, not those of other documents. A
    version is applied once: a batch that comes again after a failure replaces
    what it left, one that comes again after it was applied changes nothing.
    """
    store = _postings(spark, folder)
    if version < store.number:
        return
    columns = [F.struct("seq", F.col("deleted").alias("deleted"), "text")]
    last = batch.groupBy("doc_id").agg(F.max(*columns).alias("v")).select("doc_id", "v.text", "v.deleted").persist()
    try:
        store.save({"postings": lexical.postings(last.filter("not deleted"))}, {"postings": last}, 0.0, version + 1)
    finally:
        last.unpersist()


def follow(changes: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Applies a stream of changes (doc_id, text, deleted, seq) batch by batch."""
    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, v: apply_delta(df.sparkSession, folder, df, v)).trigger(availableNow=True).start()
