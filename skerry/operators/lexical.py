"""Keyword index and search: postings, BM25+ scores, prefix expansion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.text import code_tokens


@dataclass(frozen=True)
class Bm25:
    """Parameters of BM25+ (length: distinct terms) and of the weight of prefix matches."""

    k1: float = 1.2
    b: float = 0.7
    delta: float = 0.5
    prefix_weight: float = 0.375
    prefix_decay: float = 0.3


def doc_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: str) -> DataFrame:
    """(doc_id, terms, tfs) with the columns named in ``more``: a document's distinct terms, ascending, and their counts.

    All of a document's tokens are in its row, so they are sorted and counted there, without a shuffle.
    """

    def runs(t: Column) -> Column:
        n = F.size(t)
        starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at(t, i) != F.element_at(t, i - 1)))
        return F.when(n > 0, F.struct(t.alias("t"), starts.alias("at"))).otherwise(F.struct(t.alias("t"), F.array().cast("array<int>").alias("at")))

    def counted(r: Column) -> Column:
        after = lambda j: F.coalesce(F.try_element_at(r["at"], j + 2), F.size(r["t"]) + 1)
        return F.struct(F.transform(r["at"], lambda i: F.element_at(r["t"], i)).alias("terms"), F.transform(r["at"], lambda i, j: after(j) - i).alias("tfs"))

    bound = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)  # noqa: E731  evaluates c once
    tokens = F.sort_array(code_tokens(F.coalesce(text_col, F.lit(""))))
    got = docs.select(F.col(id_col).alias("doc_id"), bound(bound(tokens, runs), counted).alias("c"), *[F.col(c).alias(name) for name, c in more.items()])
    return got.select("doc_id", "c.terms", "c.tfs", *more)


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf) of documents with distinct ids; counted within each document's row."""
    rows = doc_terms(docs, id_col, text_col).select("doc_id", F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
    return rows.select("doc_id", F.col("x.terms").alias("term"), F.col("x.tfs").cast("long").alias("tf"))


def doc_lengths(post: DataFrame) -> DataFrame:
    return post.groupBy("doc_id").agg(F.count(F.lit(1)).alias("dl"))


def collection_stats(lengths: DataFrame) -> DataFrame:
    """One row: documents and their mean length."""
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def query_terms(queries: DataFrame, id_col: str = "qid", text_col: str = "query") -> DataFrame:
    """(qid, q): the distinct tokens of each whole query."""
    return queries.select(F.col(id_col).alias("qid"), F.explode(F.array_distinct(code_tokens(F.col(text_col)))).alias("q"))


def expand_prefixes(vocabulary: DataFrame, terms: DataFrame, p: Bm25 = Bm25(), *carry: str) -> DataFrame:
    """(qid, q, term, weight): each query term's own term and all longer ones that begin with it; ``carry`` names further columns of the vocabulary.

    An equi-join on the vocabulary's prefixes: linear in the vocabulary, where a
    starts-with condition would compare every term with every query term.
    """
    prefixes = vocabulary.select("term", *carry, F.explode(F.sequence(F.lit(2), F.length("term"))).alias("n")).select("term", *carry, F.substring(F.col("term"), F.lit(1), F.col("n")).alias("q"))
    t, q = F.length("term"), F.length("q")
    weight = F.when(F.col("term") == F.col("q"), 1.0).otherwise(p.prefix_weight * t / (t + p.prefix_decay * (t - q)))
    return terms.join(prefixes, "q").select("qid", "q", "term", weight.alias("weight"), *carry)


def exact_terms(terms: DataFrame) -> DataFrame:
    return terms.select("qid", "q", F.col("q").alias("term"), F.lit(1.0).alias("weight"))


def _score(p: Bm25) -> Column:
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf")
    return F.col("weight") * idf * (p.delta + tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * F.col("dl") / F.col("avgdl"))))


def bm25(post: DataFrame, expanded: DataFrame, p: Bm25 = Bm25()) -> DataFrame:
    """(qid, doc_id, score, matched): OR of the query's terms, times the query terms that the document has.

    Only postings of the expanded terms are kept before anything is summed;
    document frequencies come from those alone. What a query term gives a
    document is summed once, however many queries have that term.
    """
    lengths = doc_lengths(post)
    pairs, asked = expanded.select("q", "term", "weight").distinct(), expanded.select("qid", "q").distinct()
    wanted = post.join(expanded.select("term").distinct(), "term", "left_semi")
    df = wanted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    hits = wanted.join(lengths, "doc_id").join(df, "term").join(pairs, "term").crossJoin(F.broadcast(collection_stats(lengths)))
    per_term = hits.withColumn("s", _score(p)).groupBy("doc_id", "q").agg(F.sum("s").alias("s"))
    got = per_term.join(asked, "q").groupBy("qid", "doc_id").agg((F.sum("s") * F.count(F.lit(1))).alias("score"), F.count(F.lit(1)).alias("matched"))
    # nine decimals: sums in another order then give the same score, and ties stay ties
    return got.withColumn("score", F.floor(F.col("score") * 1e9 + 0.5) / 1e9)


def first_k(rows: DataFrame, k: int, order: list, by: str = "qid") -> DataFrame:
    """The first k rows of each query with their rank from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def top_k(scored: DataFrame, k: int, score: str = "score", by: str = "qid", tie: str = "doc_id", ascending: bool = False) -> DataFrame:
    """The best k rows of each query with their rank from 1; ties by ``tie``."""
    return first_k(scored, k, [F.col(score).asc() if ascending else F.col(score).desc(), F.col(tie)], by)


def relative(scored: DataFrame, score: str = "score", by: str = "qid") -> DataFrame:
    """Scores over the query's best, to four decimals; 0 where the best isn't above 0."""
    best = F.max(score).over(Window.partitionBy(by))
    return scored.withColumn(score, F.when(best > 0, F.floor(F.col(score) / best * 10000 + 0.5) / 10000).otherwise(0.0))
