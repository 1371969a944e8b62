"""From ranked chunks to results: filters, collapsing of adjacent chunks, image results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keep = Callable[[Column], Column] | None


def in_folder(path: Column, dir: str, strict: bool = False) -> Column:
    """Whether a path lies in a folder: a prefix of the path; ``strict`` stops at its border."""
    base = dir.removeprefix("./").removesuffix("/")
    if base in ("", "."):
        return F.lit(True)
    if strict:
        return (path == base) | path.startswith(base + "/")
    return path.startswith(base)


def post_filter(rows: DataFrame, threshold: float | None = None, dir: str | None = None, strict_dir: bool = False, model: Keep = None) -> DataFrame:
    """Rows of the wanted model, score and folder. A folder is a prefix of the path; ``strict_dir`` stops at its border."""
    if model is not None:
        rows = rows.filter(model(F.col("model_id")))
    if threshold is not None:
        rows = rows.filter(F.col("score") >= threshold)
    if dir is not None:
        rows = rows.filter(in_folder(F.col("file_path"), dir, strict_dir))
    return rows


def collapse(rows: DataFrame, by: str = "qid") -> DataFrame:
    """Runs of consecutive chunk indexes of a file become one row.

    (by, file_path, run_start, line_start, line_end, score, chunk_text): least
    and greatest lines, best score, texts joined by newlines in index order. A
    repeated index begins a new run. Null fields count as '' or 0.
    """
    order = Window.partitionBy(by, "file_path").orderBy("chunk_index")
    step = F.when(F.col("chunk_index") == F.lag("chunk_index").over(order) + 1, 0).otherwise(1)
    runs = rows.withColumn("_run", step).withColumn("_run", F.sum("_run").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", F.coalesce("chunk_text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n")
    return runs.groupBy(by, "file_path", "_run").agg(
        F.min("chunk_index").alias("run_start"), F.min(F.coalesce("line_start", F.lit(0))).alias("line_start"), F.max(F.coalesce("line_end", F.lit(0))).alias("line_end"),
        F.max("score").alias("score"), text.alias("chunk_text"),
    ).drop("_run")


def best(rows: DataFrame, k: int, by: str = "qid", tie: tuple[str, ...] = ("file_path", "run_start")) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("score"), *tie)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def filter_and_collapse(rows: DataFrame, k: int, by: str = "qid", **filters) -> DataFrame:
    return best(collapse(post_filter(rows, **filters), by), k, by)


def image_results(rows: DataFrame, k: int, by: str = "qid", **filters) -> DataFrame:
    """(by, file_path, score, rank): the best score of each file."""
    return best(post_filter(rows, **filters).groupBy(by, "file_path").agg(F.max("score").alias("score")), k, by, ("file_path",))


def over_fetch(k: int, post_filtered: bool) -> int:
    return k * 5 * (3 if post_filtered else 1)
