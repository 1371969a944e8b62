"""A corpus pipeline: five operators of ``skerry.llm`` in a row over ``documents``.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor
kept, and gives a DataFrame that is written as Parquet and read again. All but
the last give the columns of ``documents``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skerry.llm.bpe import encode_decode
from skerry.llm.common import cut, drop_tables, read_table, tables_made
from skerry.llm.decontaminate import drop_leaks
from skerry.llm.pii import redact_documents
from skerry.llm.quality import fit, keep_good
from skerry.llm.queries_bpe import digests, tokenizer_path
from skerry.llm.queries_quality import THRESHOLD
from skerry.llm.simhash import keep_one

ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded_sha256", pa.string())])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts go or stay by the empty text's score, a score of just
    the threshold stays, repeated rows go or stay alike, very long texts are
    read whole; columns of any name stay; no labels: all stay; an empty table
    gives an empty one.
    """
    return keep_good(docs, fit(docs, read_table(spark, sf_dir, "labels")), THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest id, null last.

    Null and empty texts are one group; of equal rows one stays; ties fall by
    hashes; very long texts are compared whole; columns of any name stay; an
    empty table gives an empty one.
    """
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts stay; repeated rows go or stay alike, rows of one id by
    their own texts; very long texts are read whole; columns of any name stay;
    an empty table on either side changes nothing.
    """
    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; ``n_chars`` follows.

    Null texts stay null and empty ones empty; repeated rows are changed alike;
    very long texts are read whole; columns of any name stay; an empty table
    gives an empty one.
    """
    return redact_documents(docs)


def _encoded(ids: list, tokens: list, pieces: list[list[str]]) -> dict[str, list]:
    got = digests(ids, tokens, pieces)
    return {"doc_id": ids, "n_tokens": got["n_tokens"], "ids": tokens, "decoded_sha256": got["decoded_sha256"]}


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of the text that they decode to.

    A row for each row: null and empty texts have no ids, null and repeated ids
    are kept, very long texts are encoded whole; other columns are left out, so
    that their names can't clash; an empty table gives an empty one.
    """
    return encode_decode(docs, tokenizer_path(), project=_encoded, schema=ENCODED)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pii", pii), ("bpe", bpe)]

#: Hashing, a trained network and a tokenizer: no SQL. tests/llm/test_pipeline.py holds it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through all stages; each stage's rows are written before the next one reads them.

    What a stage has written on its way goes as soon as its own rows are there.
    """
    docs, since = read_table(spark, sf_dir, "documents"), tables_made()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
            drop_tables(spark, since, but_last=True)
    return docs
