"""Reciprocal rank fusion of two rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rrf(semantic: DataFrame, lexical: DataFrame, k: int = 60, id_col: str = "id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(qid, id, semantic_rank, lexical_rank, carried columns, score, rank) of ids in either ranking.

    Both inputs have qid, id, rank from 1 and the carried columns; those come
    from the better-ranked side (semantic on ties). The score is over the
    query's best, to four decimals; equal scores follow the semantic rank, then
    the lexical one.
    """
    left = semantic.select("qid", F.col(id_col).alias("id"), F.col("rank").alias("semantic_rank"), *[F.col(c).alias(f"_s_{c}") for c in carry])
    right = lexical.select("qid", F.col(id_col).alias("id"), F.col("rank").alias("lexical_rank"), *[F.col(c).alias(f"_l_{c}") for c in carry])
    both = left.join(right, ["qid", "id"], "full_outer")
    part = lambda c: F.coalesce(1 / (k + F.col(c)), F.lit(0.0))
    lexical_first = F.col("semantic_rank").isNull() | (F.col("lexical_rank") < F.col("semantic_rank"))
    both = both.withColumn("raw", part("semantic_rank") + part("lexical_rank"))
    score = F.floor(F.col("raw") / F.max("raw").over(Window.partitionBy("qid")) * 10000 + 0.5) / 10000
    both = both.select("qid", "id", "semantic_rank", "lexical_rank", *[F.when(lexical_first, F.col(f"_l_{c}")).otherwise(F.col(f"_s_{c}")).alias(c) for c in carry], score.alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("semantic_rank"), F.asc_nulls_last("lexical_rank"))
    return both.withColumn("rank", F.row_number().over(order))
