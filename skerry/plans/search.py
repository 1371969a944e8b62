"""Queries over search: tokens, keyword search, neighbours, fusion, results, quality."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.functions.text import code_tokens, r4
from skerry.functions.vectors import l2_norm, mean_of, truncate
from skerry.operators import blocks, fusion, knn, lexical, lists, metrics, results
from skerry.sources.shared import kept, new_dir
from skerry.sources.tables import spread, table

K = 10
DEEP = 50

# --- SQL shared by several queries ---

TOKEN_SQL = """list_filter(list_concat(
  string_split_regex(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([a-zA-Z])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-zA-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'),
  list_transform(list_filter(string_split_regex({t}, '[^a-zA-Z0-9]+'), lambda w: regexp_matches(w, '[a-z][A-Z]|[A-Z][A-Z][a-z]|[a-zA-Z][0-9]|[0-9][a-zA-Z]')), lambda w: lower(w))
), lambda x: length(x) >= 2)"""

POSTINGS_SQL = f"""
tokens AS (SELECT doc_id, unnest({TOKEN_SQL.format(t="text")}) AS term FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS dl FROM post GROUP BY ALL),
stats AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM lengths),
terms AS (SELECT DISTINCT item_id AS qid, unnest({TOKEN_SQL.format(t="text")}) AS q FROM benchmark)"""

EXACT_SQL = "expanded AS (SELECT qid, q, q AS term, 1.0::DOUBLE AS weight FROM terms)"
PREFIX_SQL = """
vocab AS (SELECT DISTINCT term FROM post),
expanded AS (SELECT qid, q, term, CASE WHEN term = q THEN 1.0::DOUBLE ELSE 0.375::DOUBLE * length(term) / (length(term) + 0.3::DOUBLE * (length(term) - length(q))) END AS weight
  FROM terms JOIN vocab ON starts_with(term, q))"""

SCORED_SQL = """
df AS (SELECT term, count(*) AS df FROM post GROUP BY ALL),
per_term AS (SELECT qid, doc_id, q, sum(weight * ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (0.5::DOUBLE + tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.3::DOUBLE + 0.7::DOUBLE * dl / avgdl)))) AS s
  FROM expanded JOIN post USING (term) JOIN lengths USING (doc_id) JOIN df USING (term), stats GROUP BY ALL),
scored AS (SELECT qid, doc_id, floor(sum(s) * count(*) * 1e9 + 0.5) / 1e9 AS score, count(*) AS matched FROM per_term GROUP BY ALL)"""


def r4_sql(x: str) -> str:
    return f"(floor(({x}) * 10000 + 0.5) / 10000)"


def ranked_sql(k: int) -> str:
    return f"ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= {k})"


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the documents, written once, however often a query's plan meets it; shorter documents come first among equals where that is asked for."""
    return kept(blocks.build(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")), tie_col="n_chars"))


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text")


def _best(spark: SparkSession, sf_dir: str, k: int, prefix: bool = True) -> DataFrame:
    return blocks.search(_index(spark, sf_dir), _terms(spark, sf_dir), k, prefix)


def code_tokens_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


CODE_TOKENS_SQL = f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKEN_SQL.format(t='text')}) AS term FROM documents) GROUP BY ALL"


def page_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency of every term of the pages' source, which holds identifiers."""
    p = spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.explode(F.array_distinct(code_tokens(F.col("html")))).alias("term"))
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


PAGE_TERMS_SQL = f"SELECT term, count(*) AS df FROM (SELECT DISTINCT page_id, unnest({TOKEN_SQL.format(t='html')}) AS term FROM pages) GROUP BY ALL"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", r4(F.col("score")))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_best(spark, sf_dir, K, False)).select("qid", "doc_id", "score", "matched", "rank")


def bm25_prefix_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_best(spark, sf_dir, K)).select("qid", "doc_id", "score", "matched", "rank")


def keyword_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.relative(_best(spark, sf_dir, DEEP)).select("qid", "doc_id", "score", "rank")


def _queries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and the query set: those whose id is divisible by 20."""
    e = table(spark, sf_dir, "embeddings")
    return e, e.filter(F.col("vec_id") % 20 == 0)


def _near(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return knn.knn(*_queries(spark, sf_dir), k)


KNN_SQL = """
pairs AS (SELECT q.vec_id AS qid, e.vec_id AS id, 1 - list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[])
    / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))) AS distance
  FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
near AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM pairs QUALIFY rank <= {k})"""
_SEARCH_SCORE = r4_sql("least(greatest(1 - distance, 0), 1)")
_IMAGE_SCORE = r4_sql("least(greatest((1 - distance - 0.15::DOUBLE) / 0.25::DOUBLE, 0), 1)")


def knn_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, K).select("qid", F.col("id").alias("vec_id"), "rank", knn.search_score().alias("score"))


def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours among the vectors that a condition keeps."""
    return knn.knn(*_queries(spark, sf_dir), K, where="label IN (1, 3, 5, 7)").select("qid", F.col("id").alias("vec_id"), "rank", knn.search_score().alias("score"))


def knn_image_rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, DEEP).select("qid", F.col("id").alias("vec_id"), "rank", knn.image_score().alias("score"))


def knn_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same neighbours from a stored index of inverted lists, with every list that a bound doesn't rule out."""
    e, q = _queries(spark, sf_dir)
    to = new_dir(spark, "lists")
    centroids = lists.fit(e, max(1, min(4096, math.isqrt(e.count()))))
    lists.write(lists.build(e, centroids), centroids, to)
    got = lists.search(lists.read(spark, to), q, K, exact=True)
    return got.select("qid", F.col("id").alias("vec_id"), "rank", knn.search_score().alias("score"))


def vec_truncate_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", truncate(F.col("embedding"), 32).alias("v"))
    return e.select("vec_id", F.size("v").alias("dims"), r4(F.element_at("v", 1)).alias("v1"), r4(F.element_at("v", 32)).alias("v32"), r4(l2_norm(F.col("v"))).alias("norm"))


VEC_SQL = f"""
WITH t AS (SELECT vec_id, list_slice(embedding, 1, 32)::DOUBLE[] AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM t)
SELECT vec_id, len(e)::INT AS dims, {r4_sql("e[1] / n")} AS v1, {r4_sql("e[32] / n")} AS v32, {r4_sql("1.0::DOUBLE")} AS norm FROM n"""


def prompt_ensemble_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four embeddings in a row as the four prompts of a query: their mean at unit length."""
    e = table(spark, sf_dir, "embeddings").withColumn("qid", F.floor(F.col("vec_id") / 4).cast("long"))
    v = e.groupBy("qid").agg(F.count(F.lit(1)).alias("prompts"), mean_of(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"])).alias("v"))
    return v.select("qid", "prompts", r4(F.element_at("v", 1)).alias("v1"), r4(F.element_at("v", 64)).alias("v64"))


PROMPT_SQL = f"""
WITH x AS (SELECT vec_id // 4 AS qid, vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
m AS (SELECT qid, i, avg(v) AS v, count(*) AS prompts FROM x GROUP BY ALL), n AS (SELECT qid, sqrt(sum(v * v)) AS n FROM m GROUP BY ALL)
SELECT qid, any_value(prompts) AS prompts, {r4_sql("max(CASE WHEN i = 1 THEN v END) / any_value(n)")} AS v1, {r4_sql("max(CASE WHEN i = 64 THEN v END) / any_value(n)")} AS v64
FROM m JOIN n USING (qid) GROUP BY qid"""


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two rankings of the same queries from one index: query terms matched by exact tokens, shorter documents first, and BM25."""
    index, terms = _index(spark, sf_dir), _terms(spark, sf_dir)
    sem = blocks.search(index, terms, DEEP, prefixes=False, by="matched", tied=True)
    lex = blocks.search(index, terms, DEEP)
    return tuple(kept(x.select("qid", F.col("doc_id").alias("id"), "rank", "score")) for x in (sem, lex))


HITS_SQL = f"""
{POSTINGS_SQL}, {PREFIX_SQL}, {SCORED_SQL}, lex AS (SELECT qid, doc_id AS id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= {DEEP}),
matches AS (SELECT qid, doc_id, count(*) AS matched FROM terms JOIN post ON term = q GROUP BY ALL),
sem AS (SELECT qid, doc_id AS id, row_number() OVER (PARTITION BY qid ORDER BY matched DESC, n_chars, doc_id) AS rank FROM matches JOIN documents USING (doc_id) QUALIFY rank <= {DEEP})"""


def _fused_sql(sem: str = "sem", lex: str = "lex") -> str:
    return f"""
joined AS (SELECT coalesce(s.qid, l.qid) AS qid, coalesce(s.id, l.id) AS id, s.rank AS semantic_rank, l.rank AS lexical_rank,
    coalesce(1 / (60 + s.rank), 0) + coalesce(1 / (60 + l.rank), 0) AS raw FROM {sem} s FULL JOIN {lex} l ON s.qid = l.qid AND s.id = l.id),
normed AS (SELECT *, {r4_sql("raw / max(raw) OVER (PARTITION BY qid)")} AS score FROM joined),
fused AS (SELECT qid, id, semantic_rank, lexical_rank, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, semantic_rank NULLS LAST, lexical_rank NULLS LAST) AS rank FROM normed)"""


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rrf(*_hits(spark, sf_dir))


def _as_chunks(spark: SparkSession, sf_dir: str, ranked: DataFrame) -> DataFrame:
    """Hits as chunks: a source is a file, its documents are the chunks."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file_path"), F.col("doc_id").alias("chunk_index"), "text")
    return ranked.join(d, "id").select("qid", "file_path", "chunk_index", F.col("chunk_index").alias("line_start"), (F.col("chunk_index") + 9).alias("line_end"), F.col("text").alias("chunk_text"), "score")


CHUNKS_SQL = """
chunks AS (SELECT qid, source AS file_path, id AS chunk_index, id AS line_start, id + 9 AS line_end, text AS chunk_text, score FROM {t} JOIN documents ON doc_id = id)"""


def _collapse_sql(source: str = "chunks", by: str = "qid") -> str:
    w = f"PARTITION BY {by}, file_path ORDER BY chunk_index"
    return f"""
steps AS (SELECT *, CASE WHEN chunk_index = lag(chunk_index) OVER ({w}) + 1 THEN 0 ELSE 1 END AS step FROM {source}),
runs AS (SELECT *, sum(step) OVER ({w} ROWS UNBOUNDED PRECEDING) AS run FROM steps),
collapsed AS (SELECT {by}, file_path, min(chunk_index) AS run_start, min(line_start) AS line_start, max(line_end) AS line_end, max(score) AS score,
  string_agg(coalesce(chunk_text, ''), chr(10) ORDER BY chunk_index) AS chunk_text FROM runs GROUP BY {by}, file_path, run)"""


def _best_sql(k: int, by: str = "qid") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, file_path, run_start) AS rank FROM collapsed QUALIFY rank <= {k}"


def hybrid_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.filter_and_collapse(_as_chunks(spark, sf_dir, rrf_fuse(spark, sf_dir)), K)


def hybrid_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword and vector search of the same queries, fused and collapsed.

    The vector of a document is that of its number, and so is a query's; a
    query without a vector is answered by keywords alone.
    """
    e = table(spark, sf_dir, "embeddings")
    asked = e.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    sem = knn.knn(e, asked, DEEP).select("qid", "id", "rank")
    lex = _best(spark, sf_dir, DEEP).select("qid", F.col("doc_id").alias("id"), "rank")
    return results.filter_and_collapse(_as_chunks(spark, sf_dir, fusion.rrf(sem, lex)), K)


VECTOR_HITS_SQL = f"""
{POSTINGS_SQL}, {PREFIX_SQL}, {SCORED_SQL}, lex AS (SELECT qid, doc_id AS id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= {DEEP}),
{KNN_SQL.format(k=DEEP).replace("WHERE q.vec_id % 20 = 0", "WHERE q.vec_id IN (SELECT item_id FROM benchmark)")}, sem AS (SELECT qid, id, rank FROM near)"""


def mode_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword-only, semantic-only and fused answers side by side."""
    sem, lex = _hits(spark, sf_dir)
    keyword = lexical.relative(lex)
    none = lex.limit(0)
    out = keyword.select(F.lit("keyword").alias("mode"), "qid", "id", "rank", "score")
    for mode, df in (("semantic", fusion.rrf(sem, none)), ("hybrid", fusion.rrf(sem, lex))):
        out = out.unionByName(df.select(F.lit(mode).alias("mode"), "qid", "id", "rank", "score"))
    return out


MODES_SQL = f"""
WITH {HITS_SQL}, {_fused_sql()},
kw AS (SELECT qid, doc_id AS id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= {DEEP})
SELECT 'keyword' AS mode, qid, id, rank, {r4_sql("score / max(score) OVER (PARTITION BY qid)")} AS score FROM kw
UNION ALL SELECT 'semantic', qid, id, rank, {r4_sql("(1 / (60 + rank)) / (1 / 61)")} FROM sem
UNION ALL SELECT 'hybrid', qid, id, rank, score FROM fused"""


def envelope_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document for each query, results in order."""
    rows = hybrid_query(spark, sf_dir)
    item = F.struct("rank", F.col("file_path").alias("file"), F.struct(F.col("line_start").alias("start"), F.col("line_end").alias("end")).alias("lines"), "score", F.col("chunk_text").alias("text"))
    got = rows.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("rank")).alias("text"))
    return got.select("qid", F.to_json(F.struct(F.col("qid").alias("query"), F.lit("hybrid").alias("mode"), "text")).alias("envelope"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files, turns as chunks; every third index is skipped, so runs end."""
    c = table(spark, sf_dir, "conversations")
    t = F.col("turn")
    return c.select(
        F.col("role").alias("qid"), F.concat(F.lit("talk/"), F.col("conv_id").cast("string")).alias("file_path"), (t + F.floor(t / 3)).alias("chunk_index"), (t * 10 + 1).alias("line_start"),
        (t * 10 + 10).alias("line_end"), F.col("text").alias("chunk_text"), ((t * 37 + F.col("conv_id") * 11) % 100 / 100).alias("score"),
    )


TURNS_SQL = """chunks AS (SELECT role AS qid, 'talk/' || conv_id AS file_path, turn + turn // 3 AS chunk_index, turn * 10 + 1 AS line_start, turn * 10 + 10 AS line_end, text AS chunk_text,
  ((turn * 37 + conv_id * 11) % 100) / 100 AS score FROM conversations)"""


def collapse_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _turns(spark, sf_dir).withColumn("qid", F.lit(0))
    return results.collapse(c)


def threshold_dir_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.filter_and_collapse(_turns(spark, sf_dir), 5, threshold=0.5, dir="./talk/1")


def image_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _near(spark, sf_dir, DEEP).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")
    rows = rows.select("qid", F.concat(F.lit("img/"), F.col("label").cast("string"), F.lit(".png")).alias("file_path"), knn.image_score().alias("score"))
    return results.image_results(rows, 5, threshold=0.01)


IMAGE_SQL = f"""
WITH {KNN_SQL.format(k=DEEP)}, hits AS (SELECT qid, 'img/' || label || '.png' AS file_path, max({_IMAGE_SCORE}) AS score FROM near JOIN embeddings ON vec_id = id GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, file_path) AS rank FROM hits WHERE score >= 0.01 QUALIFY rank <= 5"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours without the query itself; relevant are all others of its label."""
    e, q = _queries(spark, sf_dir)
    near = knn.knn(e, q, K + 1).filter("id <> qid")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id")))
    return metrics.ir_metrics_by_label(near.select("qid", "id", "rank"), e.select(F.col("vec_id").alias("id"), "label"), q.select(F.col("vec_id").alias("qid"), "label"))


def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("qid", *[r4(F.col(c)).alias(c) for c in ("rr", "p1", "recall", "ndcg")], "hit")


def ir_metrics_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mean_metrics(_metrics(spark, sf_dir)).select(*[r4(F.col(c)).alias(c) for c in ("mrr", "p1", "recall", "ndcg")], "n")


METRICS_SQL = f"""
WITH {KNN_SQL.format(k=K + 1)}, ranked AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM near WHERE id <> qid),
rel AS (SELECT q.vec_id AS qid, e.vec_id AS id FROM embeddings q JOIN embeddings e USING (label) WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id),
size AS (SELECT qid, count(*) AS n FROM rel GROUP BY ALL),
hits AS (SELECT qid, rank FROM ranked JOIN rel USING (qid, id)),
per AS (SELECT qid, min(rank) AS first, count(*) FILTER (rank <= 3) AS in_k, sum(CASE WHEN rank <= 3 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM hits GROUP BY ALL),
m AS (SELECT qid, coalesce(1 / first, 0) AS rr, CASE WHEN first = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS p1, coalesce(in_k / n, 0) AS recall,
  coalesce(dcg / CASE least(n, 3) WHEN 1 THEN 1 WHEN 2 THEN 1 + 1 / log2(3) ELSE 1 + 1 / log2(3) + 1 / log2(4) END, 0) AS ndcg, CASE WHEN in_k > 0 THEN 1 ELSE 0 END AS hit FROM size LEFT JOIN per USING (qid))"""


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.latency_summary(table(spark, sf_dir, "events"), "event_type", "value")
    return got.withColumn("mean", r4(F.col("mean")))


LATENCY_SQL = f"""
WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY ALL)
SELECT event_type, len(v) AS n, {r4_sql("list_sum(v) / len(v)")} AS mean, v[1] AS least, v[-1] AS most,
  v[floor(len(v) * 0.5)::INT + 1] AS p50, v[floor(len(v) * 0.95)::INT + 1] AS p95, v[floor(len(v) * 0.99)::INT + 1] AS p99 FROM s"""

QUERIES = {
    f.__name__: f
    for f in (
        code_tokens_tf, page_terms, bm25_topk, bm25_prefix_topk, keyword_normalized, knn_cosine_topk, knn_lists, knn_filtered, knn_image_rescaled, vec_truncate_norm, prompt_ensemble_mean, rrf_fuse, hybrid_query, hybrid_vectors,
        mode_branches, envelope_json, collapse_adjacent, threshold_dir_topk, image_dedupe, ir_metrics, ir_metrics_agg, latency_percentiles,
    )
}

_TOP = f"SELECT qid, doc_id, {r4_sql('score')} AS score, matched, rank FROM ranked"
SQL = {
    "code_tokens_tf": CODE_TOKENS_SQL,
    "page_terms": PAGE_TERMS_SQL,
    "bm25_topk": f"WITH {POSTINGS_SQL}, {EXACT_SQL}, {SCORED_SQL}, {ranked_sql(K)} {_TOP}",
    "bm25_prefix_topk": f"WITH {POSTINGS_SQL}, {PREFIX_SQL}, {SCORED_SQL}, {ranked_sql(K)} {_TOP}",
    "keyword_normalized": f"WITH {POSTINGS_SQL}, {PREFIX_SQL}, {SCORED_SQL}, {ranked_sql(DEEP)} SELECT qid, doc_id, {r4_sql('score / max(score) OVER (PARTITION BY qid)')} AS score, rank FROM ranked",
    "knn_cosine_topk": f"WITH {KNN_SQL.format(k=K)} SELECT qid, id AS vec_id, rank, {_SEARCH_SCORE} AS score FROM near",
    "knn_lists": f"WITH {KNN_SQL.format(k=K)} SELECT qid, id AS vec_id, rank, {_SEARCH_SCORE} AS score FROM near",
    "knn_filtered": f"WITH {KNN_SQL.format(k=K).replace('WHERE q.vec_id % 20 = 0', 'WHERE q.vec_id % 20 = 0 AND e.label IN (1, 3, 5, 7)')} SELECT qid, id AS vec_id, rank, {_SEARCH_SCORE} AS score FROM near",
    "knn_image_rescaled": f"WITH {KNN_SQL.format(k=DEEP)} SELECT qid, id AS vec_id, rank, {_IMAGE_SCORE} AS score FROM near",
    "vec_truncate_norm": VEC_SQL,
    "prompt_ensemble_mean": PROMPT_SQL,
    "rrf_fuse": f"WITH {HITS_SQL}, {_fused_sql()} SELECT * FROM fused",
    "hybrid_query": f"WITH {HITS_SQL}, {_fused_sql()}, {CHUNKS_SQL.format(t='fused')}, {_collapse_sql()} {_best_sql(K)}",
    "hybrid_vectors": f"WITH {VECTOR_HITS_SQL}, {_fused_sql()}, {CHUNKS_SQL.format(t='fused')}, {_collapse_sql()} {_best_sql(K)}",
    "envelope_json": f"""WITH {HITS_SQL}, {_fused_sql()}, {CHUNKS_SQL.format(t='fused')}, {_collapse_sql()}, best AS ({_best_sql(K)})
      SELECT qid, to_json({{'query': qid, 'mode': 'hybrid', 'text': list({{'file': file_path, 'lines': {{'start': line_start, 'end': line_end}}, 'score': score, 'text': chunk_text}} ORDER BY rank)}})::VARCHAR AS envelope
      FROM best GROUP BY qid""",
    "mode_branches": MODES_SQL,
    "collapse_adjacent": f"WITH {TURNS_SQL.replace('role AS qid', '0 AS qid')}, {_collapse_sql()} SELECT * FROM collapsed",
    "threshold_dir_topk": f"WITH {TURNS_SQL}, kept AS (SELECT * FROM chunks WHERE score >= 0.5 AND starts_with(file_path, 'talk/1')), {_collapse_sql('kept')} {_best_sql(5)}",
    "image_dedupe": IMAGE_SQL,
    "ir_metrics": f"{METRICS_SQL} SELECT qid, {r4_sql('rr')} AS rr, {r4_sql('p1')} AS p1, {r4_sql('recall')} AS recall, {r4_sql('ndcg')} AS ndcg, hit FROM m",
    "ir_metrics_agg": f"{METRICS_SQL} SELECT {r4_sql('avg(rr)')} AS mrr, {r4_sql('avg(p1)')} AS p1, {r4_sql('avg(recall)')} AS recall, {r4_sql('avg(ndcg)')} AS ndcg, count(*) AS n FROM m",
    "latency_percentiles": LATENCY_SQL,
}
