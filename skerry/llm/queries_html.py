"""op3: the main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import read_table
from skerry.llm.html import main_text


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
