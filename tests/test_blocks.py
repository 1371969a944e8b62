import random

import pytest
from pyspark.sql import functions as F

from skerry.operators import blocks, lexical


def words(rnd, n):
    """A few common words and many rare ones, some of them beginnings of others."""
    return " ".join(rnd.choice(["the", "of", "node", "nodes", "graph"]) if rnd.random() < 0.5 else f"w{rnd.randint(0, 400)}x{rnd.choice(['', 'tail', 'er'])}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(2)
    texts = [words(rnd, rnd.randint(0, 60)) for _ in range(700)]
    texts[10:20] = texts[:10]  # equal documents: ties
    docs = spark.createDataFrame([(f"d{i:04}", t, len(t)) for i, t in enumerate(texts)] + [("empty", "", 0), ("null", None, 0)], "id string, text string, size int").repartition(5)
    queries = [(i, texts[i * 7][:120] if i % 2 else words(rnd, 6)) for i in range(30)] + [(98, "zzzz nothing"), (99, "")]
    return docs, lexical.query_terms(spark.createDataFrame(queries, "qid long, query string"))


def rows(df):
    return {(r["qid"], r["rank"], r["doc_id"], r["matched"], round(r["score"], 6)) for r in df.collect()}


@pytest.fixture(scope="module")
def index(spark, corpus):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # several blocks a task
    try:
        got = blocks.build(corpus[0], "id", "text", "size").cache()
        assert got.filter("term is null").count() >= 14
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    return got


def test_postings_are_counted_in_the_row(spark):
    d = spark.createDataFrame([(1, "aa bb aa fooBar"), (2, None), (3, ""), (4, "x"), (5, "zz")], "doc_id long, text string")
    got = {(r["doc_id"], r["term"], r["tf"]) for r in lexical.postings(d).collect()}
    assert got == {(1, "aa", 2), (1, "bb", 1), (1, "foo", 1), (1, "bar", 1), (1, "foobar", 1), (5, "zz", 1)}
    assert lexical.doc_terms(d).filter("doc_id = 1").first()["terms"] == ["aa", "bar", "bb", "foo", "foobar"]


@pytest.mark.parametrize("prefixes", [True, False])
def test_search_equals_plain_scoring(spark, corpus, index, prefixes):
    docs, terms = corpus
    post = lexical.postings(docs, "id")
    expanded = lexical.expand_prefixes(post.select("term").distinct(), terms) if prefixes else lexical.exact_terms(terms)
    for k in (1, 10):
        want = rows(lexical.top_k(lexical.bm25(post, expanded), k))
        assert rows(blocks.search(index, terms, k, prefixes)) == want and len(want) > 20
    assert rows(blocks.search(index, terms, 10, prefixes, queries=7)) == want


def test_most_postings_are_left_out(spark, corpus, index):
    got = blocks.search(index, corpus[1], 3, counted=True).agg(F.sum("scored"), F.sum("asked")).first()
    assert 0 < got[0] < 0.5 * got[1]


def test_matches(spark, corpus, index):
    docs, terms = corpus
    held = docs.select("id", "size", F.explode(F.array_distinct(lexical.code_tokens(F.coalesce("text", F.lit(""))))).alias("q"))
    all_ = terms.join(held, "q").groupBy("qid", "id", "size").agg(F.count(F.lit(1)).alias("n")).collect()
    want = set()
    for q in {r["qid"] for r in all_}:
        mine = sorted((-r["n"], r["size"], r["id"]) for r in all_ if r["qid"] == q)[:8]
        want |= {(q, i + 1, d, -n, float(-n)) for i, (n, _, d) in enumerate(mine)}
    assert rows(blocks.search(index, terms, 8, False, by="matched", tied=True)) == want


def test_empty_sides(spark, corpus, index):
    docs, terms = corpus
    assert blocks.search(index, terms.limit(0), 5).count() == 0
    assert blocks.search(blocks.build(docs.limit(0), "id"), terms, 5).count() == 0
    assert blocks.search(blocks.build(docs.filter("id in ('empty', 'null')"), "id"), terms, 5).count() == 0


def test_scores_are_the_same_to_the_last_bit_however_blocks_are_cut(spark):
    rnd = random.Random(8)
    texts = [words(rnd, rnd.randint(300, 400)) for _ in range(80)]
    docs = spark.createDataFrame([(i, texts[i % 80] if i % 3 else words(rnd, 350)) for i in range(640)], "id long, text string")
    terms = lexical.query_terms(spark.createDataFrame([(i, texts[i]) for i in range(0, 80, 2)], "qid long, query string")).cache()
    got = []
    for n in (1, 3, 11):
        index = blocks.build(docs.repartition(n), "id", "text").cache()
        got.append({(r["qid"], r["doc_id"]): (r["score"], r["rank"]) for r in blocks.search(index, terms, 60).collect()})
    assert got[0] == got[1] == got[2] and len(got[0]) == 2400
    by_text: dict = {}
    for (q, d), (s, _) in got[0].items():
        if d % 3:
            by_text.setdefault((q, d % 80), set()).add(s)
    assert all(len(s) == 1 for s in by_text.values())


def test_a_block_has_a_bounded_number_of_postings_and_answers_stay(spark, corpus, index):
    docs, terms = corpus
    got = blocks.build(docs, "id", "text", "size", postings=200).cache()
    own = [r["dl"] for r in got.filter("term is null").select("dl").collect()]
    assert all(sum(dl) <= 200 or len(dl) == 1 for dl in own) and sum(map(len, own)) == 702 and max(map(len, own)) > 1
    assert sum(map(sum, own)) == got.agg(F.sum("n")).first()[0]
    assert blocks.build(docs, "id", "text", "size", postings=1).filter("term is null and size(dl) > 0").selectExpr("max(aggregate(dl, 0, (a, x) -> a + if(x > 0, 1, 0)))").first()[0] == 1
    for by in ("score", "matched"):
        assert rows(blocks.search(got, terms, 10, by=by, tied=True)) == rows(blocks.search(index, terms, 10, by=by, tied=True))


def test_long_documents_make_no_larger_blocks(spark):
    docs = spark.range(0, 3000, 1, 1).selectExpr("id", "concat_ws(' ', transform(sequence(1, 1000), i -> concat('w', id % 7, 'x', i))) AS text")
    own = [sum(r["dl"]) for r in blocks.build(docs, "id", "text").filter("term is null").select("dl").collect()]
    assert sum(own) >= 3_000_000 and max(own) <= blocks.POSTINGS
