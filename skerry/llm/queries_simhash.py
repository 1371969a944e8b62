"""op7: near-duplicate components of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skerry.llm.common import read_table
from skerry.llm.simhash import hex_of, near_duplicates


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")
