"""Columns whose names or types get in the way: dots, maps, and names that operators use inside."""

import time

import pytest
from helpers import DOCS, ODD, PASSAGE, docs
from pyspark.sql import functions as F

from skerry.llm.decontaminate import drop_leaks
from skerry.llm.html import Page
from skerry.llm.pii import redact_documents
from skerry.llm.quality import fit, keep_good
from skerry.llm.simhash import keep_one

OWN = ["a.b", "c0", "c4", "doc_id_", "bad_id", "__bad_id", "__bad_hash", "__keep_doc_id", "first_doc_id", "text_hash", "row_hash", "key", "_text", "_sh", "hs", "own", "item_id", "m", "`x`", "with space"]


@pytest.fixture(scope="module")
def odd(spark):
    d = docs(spark, extra=False).withColumns({c: F.lit(3) for c in OWN}).withColumn("map", F.create_map(F.lit("k"), F.col("n_chars"))).withColumn("nest", F.struct(F.lit(1).alias("a.b")))
    return d.withColumnRenamed("source", "so.urce")


def same_shape(got, like):
    assert got.columns == like.columns and [t for _, t in got.dtypes] == [t for _, t in like.dtypes]
    return got.collect()


def test_every_operator_of_rows_keeps_all_columns(spark, odd):
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    rows = same_shape(drop_leaks(odd, items), odd)
    assert len(rows) == len(ODD) - 1 and {r["a.b"] for r in rows} == {3} and 8 not in {r["doc_id"] for r in rows}
    rows = same_shape(redact_documents(odd), odd)
    assert len(rows) == len(ODD) and next(r for r in rows if r["doc_id"] == 1)["text"].startswith("Plain text with Some words. Mail [EMAIL] or [IP]")
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, quality int")
    same_shape(keep_good(odd, fit(odd, labels), 0.0), odd)
    rows = same_shape(keep_one(odd), odd)
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "2", "5", "7", "8", "None"]


def test_repeated_rows_with_a_map_stay_once(spark, odd):
    twice = odd.unionByName(odd)
    assert sorted(str(r["doc_id"]) for r in keep_one(twice).collect()) == ["1", "2", "5", "7", "8", "None"]


def test_unlike_texts_under_one_id_both_stay(spark):
    rows = [(1, "one two three four five six seven", "en", "s", 1), (1, "quite other words stand in this second text", "en", "s", 1)]
    assert keep_one(spark.createDataFrame(rows, DOCS)).count() == 2


@pytest.mark.parametrize("page", ["<i>" * 20_000 + "<h3>" * 20_000, "<p><table>" + "<b>" * 30_000 + "</i>" * 30_000 + "<h3>" * 3_000, "<ul>" + "<li><b>x" * 30_000, "<div>" * 30_000 + "</p>" * 30_000])
def test_bad_markup_takes_linear_time(page):
    began = time.time()
    Page(page * (1 + 1_000_000 // len(page)))
    assert time.time() - began < 20
