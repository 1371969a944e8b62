"""Retrieval quality and latency figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.sources.shared import kept


def ir_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 3) -> DataFrame:
    """Per query of ``relevant``: reciprocal rank, precision at 1, recall and nDCG at k, and whether anything was hit.

    ``ranked`` has qid, id, rank; ``relevant`` qid, id (distinct). A query
    without an answer scores 0; a query with nothing relevant isn't listed.
    """
    size = relevant.groupBy("qid").agg(F.count(F.lit(1)).alias("n_relevant"))
    return _measured(ranked.join(relevant, ["qid", "id"], "left_semi").select("qid", "rank"), size, k)


def ir_metrics_by_label(ranked: DataFrame, items: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """The same where all other items of a query's label are relevant.

    ``items`` has id, label (ids distinct), ``queries`` qid, label; a query that
    is an item isn't its own answer. Relevant items are counted by label, not
    written out: a label that a third of all items have costs one row.
    """
    labels = items.groupBy("label").agg(F.count(F.lit(1)).alias("n_label"))
    own = queries.join(items.select(F.col("id").alias("qid"), F.col("label").alias("own_label")), "qid", "left")
    same = F.when(F.col("own_label") == F.col("label"), 1).otherwise(0)
    size = own.join(labels, "label").select("qid", (F.col("n_label") - same).alias("n_relevant")).filter("n_relevant > 0")
    answers = ranked.filter("id <> qid").join(queries.select("qid", F.col("label").alias("wanted")), "qid").join(items, "id").filter("label = wanted")
    return _measured(answers.select("qid", "rank"), size, k)


def _measured(hits: DataFrame, size: DataFrame, k: int) -> DataFrame:
    """Figures of each query of ``size`` (qid, n_relevant) from the ranks of its relevant answers."""
    in_k = F.col("rank") <= k
    got = hits.groupBy("qid").agg(
        F.min("rank").alias("first"), F.sum(F.when(in_k, 1).otherwise(0)).alias("in_k"), F.sum(F.when(in_k, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return size.join(got, "qid", "left").select(
        "qid", zero(1 / F.col("first")).alias("rr"), F.when(F.col("first") == 1, 1.0).otherwise(0.0).alias("p1"),
        zero(F.col("in_k") / F.col("n_relevant")).alias("recall"), zero(F.col("dcg") / ideal).alias("ndcg"), F.when(F.col("in_k") > 0, 1).otherwise(0).alias("hit"),
    )


def mean_metrics(per_query: DataFrame) -> DataFrame:
    """Means and the number of queries; zeros without any."""
    avg = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return per_query.agg(avg("rr").alias("mrr"), avg("p1").alias("p1"), avg("recall").alias("recall"), avg("ndcg").alias("ndcg"), F.count(F.lit(1)).alias("n"))


def latency_summary(samples: DataFrame, by: str, value: str, ps: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Percentiles as sorted[floor(n*p)], not interpolated, with mean, least and most.

    Distributed selection: groups and distinct values are dealt by range, so a
    group of any size lies in as many partitions as it needs. Each partition
    adds its counts up by itself; how many samples of the group lie before it
    follows from one sum a partition and group. No group is gathered.
    """
    spark = samples.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    rows = samples.select(F.col(by).alias("g"), F.col(value).alias("x")).filter("x is not null")
    counts = rows.groupBy("g", "x").agg(F.count(F.lit(1)).alias("c"))
    # written, as the numbers of partitions must be the same whenever they are read
    parts = kept(counts.repartitionByRange(n, "g", "x").withColumn("part", F.spark_partition_id()))
    here = parts.groupBy("g", "part").agg(F.sum("c").alias("here"), F.sum(F.col("x") * F.col("c")).alias("total"), F.min("x").alias("least"), F.max("x").alias("most"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = here.groupBy("g").agg(F.sum("here").alias("n"), (F.sum("total") / F.sum("here")).alias("mean"), F.min("least").alias("least"), F.max("most").alias("most"))
    offsets = here.select("g", "part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("offset"))
    upto = parts.select(F.col("g").alias("h"), F.col("part").alias("at"), "x", "c", F.sum("c").over(Window.partitionBy("g", "part").orderBy("x")).alias("run"))
    ranked = upto.join(offsets, F.col("h").eqNullSafe(F.col("g")) & (F.col("at") == F.col("part"))).select("g", "x", "c", (F.col("run") + F.col("offset")).alias("hi"))
    wide = ranked.withColumnRenamed("g", "h").join(sums, F.col("h").eqNullSafe(F.col("g")))
    at = lambda p: F.floor(F.col("n") * p)
    pick = lambda p: F.max(F.when((F.col("hi") > at(p)) & (F.col("hi") - F.col("c") <= at(p)), F.col("x")))
    first = lambda c: F.first(c).alias(c)
    return wide.groupBy("g").agg(first("n"), first("mean"), first("least"), first("most"), *[pick(p).alias(f"p{round(p * 100)}") for p in ps]).withColumnRenamed("g", by)
