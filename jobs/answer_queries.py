"""Answers a table of saved queries from a table of documents, and says which sources answer them.

A team that keeps a list of searches (and judges its index by them) runs this
after its documents changed. The documents are indexed once, the queries are
answered in batches, and the answers are laid out by the folder that they come
from, as users filter by folder.

Output, all of it Parquet and replaced by each run:

* ``index``: blocks of postings (``skerry.operators.blocks``);
* ``answers``, by source: qid, doc_id, rank, score (four decimals), matched;
* ``sources``: source, hits, queries, firsts: its answers, the queries that it
  answers, and those that it answers best.

A table is written from tables that stand, so a run that failed is made good by
the next one, and a second run writes the same rows.
"""

from __future__ import annotations

import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, command_line, read_config
from skerry.functions.text import r4
from skerry.operators import blocks, lexical
from skerry.plans import search as S
from skerry.sources.shared import new_dir
from skerry.sources.tables import spread

P = lexical.Bm25()
DEFAULTS = {"k": 10, "prefixes": True, "k1": P.k1, "b": P.b, "delta": P.delta, "prefix_weight": P.prefix_weight, "prefix_decay": P.prefix_decay, "queries_a_pass": blocks.QUERIES}
ANSWERS = "qid long, doc_id long, rank int, score double, matched int, source string"
SOURCES = "source string, hits long, queries long, firsts long"


def _write(df: DataFrame, path: str, *by: str) -> DataFrame:
    """The table as it is read back."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run(spark: SparkSession, queries: str, documents: str, output: str, settings: dict | None = None) -> dict:
    """Indexes ``documents`` (doc_id, text, source), answers ``queries`` (item_id, text); gives and logs the counts of what it read and wrote.

    Document ids are distinct. Null and empty texts are documents that answer
    nothing, null and empty queries get no answer; ties fall by document id;
    an empty source reads back as null, as partitions have it; of queries that
    share an id all terms count as one query's; further columns are left out;
    an empty table on either side gives empty answers.
    """
    s = {**DEFAULTS, **(settings or {})}
    p = lexical.Bm25(s["k1"], s["b"], s["delta"], s["prefix_weight"], s["prefix_decay"])
    docs = spark.read.parquet(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    items = spark.read.parquet(queries).select(F.col("item_id").cast("long").alias("item_id"), "text")

    index = _write(blocks.build(spread(docs)), f"{output}/index")
    terms = lexical.query_terms(items, "item_id", "text").distinct()
    best = blocks.search(index, terms, s["k"], s["prefixes"], p, queries=s["queries_a_pass"])
    answers = best.join(docs.select("doc_id", "source"), "doc_id").select("qid", "doc_id", "rank", r4(F.col("score")).alias("score"), "matched", "source")
    # few rows, so all of a source's go to one file; a source that has many is split
    answers = _write(answers.hint("rebalance", "source"), f"{output}/answers", "source")

    firsts = F.sum(F.when(F.col("rank") == 1, 1).otherwise(0))
    by_source = answers.groupBy("source").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("qid").alias("queries"), firsts.alias("firsts"))
    sources = _write(by_source, f"{output}/sources")
    got = {"documents_read": docs.count(), "queries_read": items.count(), "lists_written": index.count(), "answers_written": answers.count(), "sources_written": sources.count()}
    LOG.info("answer_queries: %s", " ".join(f"{k}={v}" for k, v in got.items()))
    return got


def read_answers(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(ANSWERS).parquet(f"{output}/answers")


def job2_answer_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over ``benchmark`` and ``documents`` into one new folder; each answer with the figures of its source."""
    to = f"{new_dir(spark, 'job2')}/out"
    for _ in range(2):
        run(spark, f"{sf_dir}/benchmark.parquet", f"{sf_dir}/documents.parquet", to)
    sources = spark.read.schema(SOURCES).parquet(f"{to}/sources").withColumnRenamed("source", "of")
    answers = read_answers(spark, to)
    return answers.join(sources, answers["source"].eqNullSafe(sources["of"])).drop("of")


JOB2_SQL = f"""
WITH {S.POSTINGS_SQL}, {S.PREFIX_SQL}, {S.SCORED_SQL}, {S.ranked_sql(S.K)},
answers AS (SELECT qid, doc_id, rank::INT AS rank, {S.r4_sql("score")} AS score, matched::INT AS matched, nullif(source, '') AS source FROM ranked JOIN documents USING (doc_id)),
sources AS (SELECT source, count(*) AS hits, count(DISTINCT qid) AS queries, count(*) FILTER (rank = 1) AS firsts FROM answers GROUP BY source)
SELECT a.*, hits, queries, firsts FROM answers a JOIN sources s ON a.source IS NOT DISTINCT FROM s.source"""


if __name__ == "__main__":

    def _work(spark: SparkSession, at: dict, config: str | None) -> None:
        run(spark, at["queries"], at["documents"], at["output"], read_config(spark, config, DEFAULTS) if config else None)

    sys.exit(command_line("answer_queries", __doc__.split("\n")[0], ("queries", "documents", "output"), _work))
