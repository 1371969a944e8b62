"""op8: spans of personal data in the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import read_table
from skerry.llm.pii import BASE, find


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    line = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return got.select("doc_id", *[count(k) for k in BASE], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
