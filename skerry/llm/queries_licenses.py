"""op5: licence scans of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import read_table
from skerry.llm.licenses import CONFIDENCE, scan


def op5_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(read_table(spark, sf_dir, "documents"))
    own = F.transform("detections", lambda d: d["label"])
    best = F.array_max(F.transform("detections", lambda d: F.element_at(F.lit(list(CONFIDENCE)), d["priority"] + 1)))
    return got.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", own)), ",").alias("labels"),
        F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(CONFIDENCE[3])).otherwise(F.lit(0.0))).alias("score"),
    )
