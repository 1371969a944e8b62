"""Queries over indexing: file types, ignore rules, chunks, differences, deltas, small functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import text as T
from skerry.operators import chunking, lexical, manifest
from skerry.plans.search import POSTINGS_SQL
from skerry.sources import tables
from skerry.sources.files import EXTENSIONS, compile_rules, file_type, ignored
from skerry.sources.tables import FILES_SQL, MANIFEST_SQL, PRESENT_SQL, table

_DIM_SQL = "dim AS (SELECT * FROM (VALUES " + ", ".join(f"('{e}', '{t}')" for e, t in EXTENSIONS.items()) + ") v(ext, type))"
RULES = ["src1/", "*.png", "!doc_2*.png", "/src7/doc_*5.*", "**/doc_13?.ts"]


def ext_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.files(spark, sf_dir).select(file_type(F.col("path")).alias("type"), "size").filter("type is not null")
    return f.groupBy("type").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.files(spark, sf_dir).filter(~ignored(F.col("path"), compile_rules(RULES))).select("doc_id", "path")


IGNORE_SQL = f"""
WITH {FILES_SQL} SELECT doc_id, path FROM files WHERE NOT (starts_with(path, 'src1/') OR CASE WHEN regexp_matches(path, '/doc_13[^/]\\.ts$') THEN true
  WHEN regexp_matches(path, '^src7/doc_[^/]*5\\.[^/]*$') THEN true WHEN regexp_matches(path, '/doc_2[^/]*\\.png$') THEN false ELSE ends_with(path, '.png') END)"""


def chunk_id_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.files(spark, sf_dir)
    return f.select("doc_id", T.chunk_id(F.col("path"), F.col("doc_id") * 7).alias("chunk_id"), "hash")


def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's chunks; a line counts as a paragraph, as the texts have no blank lines."""
    d = tables.spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(T.paragraph_chunks(F.regexp_replace("text", "\n", "\n\n"))).alias("chunk_index", "chunk"))
    return d.select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"), F.substring(F.sha2("chunk", 256), 1, 16).alias("text_hash"))


_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_EMPTY = "{'done': []::VARCHAR[], 'cur': ''}"


def _pack_sql(items: str, glue: str) -> str:
    n = len(glue.replace("' || chr(10) || chr(10) || '", "xx")) if "chr" in glue else len(glue)
    flushed = "CASE WHEN a.cur = '' THEN a.done ELSE list_append(a.done, a.cur) END"
    fold = f"""list_reduce({items}, lambda a, x: CASE
      WHEN x.hard THEN {{'done': list_append({flushed}, x.s), 'cur': '', 's': '', 'hard': false}}
      WHEN a.cur = '' THEN {{'done': a.done, 'cur': x.s, 's': '', 'hard': false}}
      WHEN length(a.cur) + {n} + length(x.s) <= 1600 THEN {{'done': a.done, 'cur': a.cur || '{glue}' || x.s, 's': '', 'hard': false}}
      ELSE {{'done': {flushed}, 'cur': x.s, 's': '', 'hard': false}} END, {{'done': []::VARCHAR[], 'cur': '', 's': '', 'hard': false}})"""
    return fold


def _item(s: str, hard: str) -> str:
    return f"{{'done': []::VARCHAR[], 'cur': '', 's': {s}, 'hard': {hard}}}"


_PARAGRAPHS_SQL = f"""
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
pars AS (SELECT doc_id, i, {_TRIM.format("l")} AS p FROM lines WHERE length({_TRIM.format("l")}) > 0),
sents AS (SELECT doc_id, i, p, CASE WHEN length(p) <= 1600 THEN NULL ELSE list_filter(string_split(regexp_replace(p, '\\.\\s+', '.' || chr(1), 'g'), chr(1)), lambda s: s <> '') END AS ss FROM pars),
items AS (SELECT doc_id, i, p, CASE WHEN ss IS NULL THEN NULL ELSE flatten(list_transform(ss, lambda s: CASE WHEN length(s) > 1600
    THEN list_transform(range(0, length(s), 1600), lambda k: {_item("substr(s, (k + 1)::INT, 1600)", "true")}) ELSE [{_item("s", "false")}] END)) END AS it FROM sents),
packed AS (SELECT doc_id, i, p, CASE WHEN it IS NULL THEN NULL ELSE {_pack_sql("it", " ")} END AS f FROM items),
pieces AS (SELECT doc_id, i, CASE WHEN f IS NULL THEN [p] WHEN f.cur = '' THEN f.done ELSE list_append(f.done, f.cur) END AS ps FROM packed)"""

#: Each document's chunks as a list ``c``.
PASSAGES_SQL = f"""{_PARAGRAPHS_SQL}, by_doc AS (SELECT doc_id, flatten(list(ps ORDER BY i)) AS ps FROM pieces GROUP BY doc_id),
soft AS (SELECT doc_id, list_transform(ps, lambda s: {_item("s", "false")}) AS it FROM by_doc),
merged AS (SELECT doc_id, {_pack_sql("it", "' || chr(10) || chr(10) || '")} AS f FROM soft),
raw AS (SELECT doc_id, CASE WHEN f.cur = '' THEN f.done ELSE list_append(f.done, f.cur) END AS c FROM merged),
kept AS (SELECT doc_id, CASE WHEN len(c) = 1 THEN c ELSE list_filter(c, lambda x: length(x) >= 200) END AS c FROM raw)"""

PARAGRAPH_SQL = f"""
WITH {PASSAGES_SQL},
rows AS (SELECT doc_id, unnest(c) AS chunk, generate_subscripts(c, 1) - 1 AS chunk_index FROM kept)
SELECT doc_id, chunk_index::INT AS chunk_index, length(chunk)::INT AS n_chars, substr(sha256(chunk), 1, 16) AS text_hash FROM rows"""


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that each line of each document gives, oversized ones split by sentences."""
    d = tables.spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l")).withColumn("p", T.trim_all(F.col("l"))).filter("length(p) > 0")
    pieces = d.select("doc_id", (F.col("i") + 1).alias("line"), F.posexplode(T.sentence_pieces(F.col("p"))).alias("piece", "s"))
    return pieces.select("doc_id", "line", "piece", F.length("s").alias("n_chars"))


SENTENCE_SQL = f"WITH {_PARAGRAPHS_SQL} SELECT doc_id, i AS line, (generate_subscripts(ps, 1) - 1)::INT AS piece, length(unnest(ps))::INT AS n_chars FROM pieces"


def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over white-space tokens with the lines that they begin and end in."""
    w = chunking.windows(tables.spread(table(spark, sf_dir, "documents").select("doc_id", "text")), chunking.regex_tokenizer(r"\S+"))
    return w.select("doc_id", "chunk_index", F.col("token_count").cast("long").alias("n_tokens"), F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"))


WINDOWS_SQL = """
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
counts AS (SELECT doc_id, i, len(list_filter(string_split_regex(l, '\\s+'), lambda w: w <> '')) AS n FROM lines),
cum AS (SELECT doc_id, i, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM counts),
docs AS (SELECT doc_id, max(c) AS n, max(i) AS n_lines FROM cum GROUP BY doc_id),
wins AS (SELECT doc_id, n, n_lines, unnest(range(0, CASE WHEN n <= 500 THEN 1 ELSE 1 + ceil((n - 500) / 450)::BIGINT END)) AS k FROM docs),
spans AS (SELECT *, k * 450 AS s, least(k * 450 + 500, n) AS e FROM wins)
SELECT s.doc_id, k::INT AS chunk_index, CASE WHEN n <= 500 THEN n ELSE e - s END::BIGINT AS n_tokens,
  CASE WHEN n <= 500 THEN 1 ELSE coalesce(min(i) FILTER (c > s), any_value(n_lines)) END AS line_start, CASE WHEN n <= 500 THEN n_lines ELSE coalesce(min(i) FILTER (c > e - 1), any_value(n_lines)) END AS line_end
FROM spans s JOIN cum USING (doc_id) GROUP BY s.doc_id, k, n, n_lines, s, e"""


def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.diff_files(tables.present(spark, sf_dir), tables.manifest(spark, sf_dir))


_DIFF_SQL = f"""{FILES_SQL}, {MANIFEST_SQL}, {PRESENT_SQL},
diff AS (SELECT coalesce(f.path, m.path) AS path, CASE WHEN m.path IS NULL THEN 'new' WHEN f.path IS NULL THEN 'deleted' WHEN f.mtime = m.mtime AND f.size = m.size THEN 'unchanged'
  WHEN f.hash = m.hash THEN 'touched' ELSE 'changed' END AS status FROM present f FULL JOIN manifest m ON f.path = m.path)"""


def _lines(df: DataFrame) -> DataFrame:
    """Lines as chunks of a file."""
    c = df.select("path", F.posexplode(F.split("text", "\n")).alias("chunk_index", "line"), "hash")
    return c.select("path", "chunk_index", T.content_hash(F.concat("line", F.substring("hash", 1, 1))).alias("text_hash"))


def chunk_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.diff_chunks(_lines(tables.present(spark, sf_dir)), _lines(tables.manifest(spark, sf_dir)))


_CHUNK_DIFF_SQL = """
new_c AS (SELECT path, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chunk_index, substr(sha256(unnest(string_split(text, chr(10))) || substr(hash, 1, 1)), 1, 16) AS h FROM present),
old_c AS (SELECT path, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chunk_index, substr(sha256(unnest(string_split(text, chr(10))) || substr(hash, 1, 1)), 1, 16) AS h FROM manifest),
cdiff AS (SELECT coalesce(n.path, o.path) AS path, coalesce(n.chunk_index, o.chunk_index)::INT AS chunk_index,
  CASE WHEN n.path IS NULL THEN 'removed' WHEN n.h = o.h THEN 'reused' ELSE 'created' END AS status FROM new_c n FULL JOIN old_c o ON n.path = o.path AND n.chunk_index = o.chunk_index)"""


def deleted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.deleted_files(tables.present(spark, sf_dir), tables.manifest(spark, sf_dir))


def staleness_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.staleness(tables.present(spark, sf_dir), tables.manifest(spark, sf_dir))


def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.manifest(spark, sf_dir).select(file_type(F.col("path")).alias("type"), F.size(F.split("text", "\n")).alias("n_chunks"), "size").filter("type is not null")
    return manifest.status_rollup(m)


STATUS_SQL = f"""
WITH {FILES_SQL}, {MANIFEST_SQL}, {_DIM_SQL}, e AS (SELECT d.type, len(string_split(text, chr(10))) AS n, size FROM manifest JOIN dim d ON ends_with(path, '.' || split_part(path, '.', -1)) AND d.ext = '.' || split_part(path, '.', -1))
SELECT t.type, count(e.type) AS files, coalesce(sum(n), 0)::BIGINT AS chunks, coalesce(sum(size), 0)::BIGINT AS bytes FROM (SELECT DISTINCT type FROM dim) t LEFT JOIN e USING (type) GROUP BY ALL"""


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.index_stats(manifest_diff(spark, sf_dir), chunk_diff(spark, sf_dir))


STATS_SQL = f"""
WITH {_DIFF_SQL}, {_CHUNK_DIFF_SQL} SELECT * FROM (SELECT count(*) FILTER (status <> 'deleted') AS files_scanned, count(*) FILTER (status IN ('new', 'changed')) AS files_indexed,
  count(*) FILTER (status IN ('unchanged', 'touched')) AS files_skipped FROM diff),
 (SELECT count(*) FILTER (status = 'created') AS chunks_created, count(*) FILTER (status = 'reused') AS chunks_reused, count(*) FILTER (status = 'removed') AS chunks_removed FROM cdiff)"""


def _delta(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The postings, and those of the benchmark's texts under the ids of documents."""
    return lexical.postings(tables.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))), lexical.postings(table(spark, sf_dir, "benchmark"), "item_id")


def _summary(post: DataFrame) -> DataFrame:
    return post.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("tokens"))


def apply_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(manifest.upsert(*_delta(spark, sf_dir), "doc_id"))


def apply_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(manifest.remove(_delta(spark, sf_dir)[0], table(spark, sf_dir, "labels"), "doc_id"))


_ITEM_POST = POSTINGS_SQL.split("post AS")[0].replace("tokens AS", "itokens AS").replace("doc_id,", "item_id AS doc_id,").replace("FROM documents", "FROM benchmark") + "ipost AS (SELECT doc_id, term, count(*) AS tf FROM itokens GROUP BY ALL)"
UPSERT_SQL = f"""WITH {POSTINGS_SQL}, {_ITEM_POST} SELECT doc_id, count(*) AS terms, sum(tf)::BIGINT AS tokens FROM
  (SELECT * FROM post WHERE doc_id NOT IN (SELECT item_id FROM benchmark) UNION ALL SELECT * FROM ipost) GROUP BY ALL"""
REMOVE_SQL = f"WITH {POSTINGS_SQL} SELECT doc_id, count(*) AS terms, sum(tf)::BIGINT AS tokens FROM post WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY ALL"


def scalar_misc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder, extension, id and time functions over pages, sizes from their html."""
    p = table(spark, sf_dir, "pages")
    u = F.col("url")
    return p.select(
        "page_id", T.normal_dir(F.concat(F.lit("./"), u, F.lit("/"))).alias("dir"), T.last_segment(u).alias("last"), T.safe_id(u).alias("safe"),
        T.format_bytes(F.length("html") * (F.col("page_id") + 1) * 97).alias("bytes"), T.iso_time(F.lit(1700000000123) + F.col("page_id") * 86399999).alias("at"),
    )


SCALAR_SQL = """
WITH p AS (SELECT page_id, url, length(html) * (page_id + 1) * 97 AS n FROM pages)
SELECT page_id, url AS dir, '.' || lower(split_part(url, '.', -1)) AS last, regexp_replace(url, '[^a-zA-Z0-9._-]', '_', 'g') AS safe,
  CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576) ELSE printf('%.1f GB', n / 1073741824) END AS bytes,
  strftime(make_timestamp((1700000000123 + page_id * 86399999) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS at FROM p"""

QUERIES = {
    f.__name__: f
    for f in (
        ext_type_counts, ignore_filter, chunk_id_hash, paragraph_chunks, sentence_split, token_windows, manifest_diff, chunk_diff, deleted_files, staleness_count, status_rollup, index_stats,
        apply_upsert, apply_remove, scalar_misc,
    )
}

SQL = {
    "ext_type_counts": f"WITH {FILES_SQL}, {_DIM_SQL} SELECT type, count(*) AS files, sum(size)::BIGINT AS bytes FROM files JOIN dim ON ext = '.' || split_part(path, '.', -1) GROUP BY ALL",
    "ignore_filter": IGNORE_SQL,
    "chunk_id_hash": f"WITH {FILES_SQL} SELECT doc_id, substr(sha256(path), 1, 12) || '_' || printf('%04d', doc_id * 7) AS chunk_id, hash FROM files",
    "paragraph_chunks": PARAGRAPH_SQL,
    "sentence_split": SENTENCE_SQL,
    "token_windows": WINDOWS_SQL,
    "manifest_diff": f"WITH {_DIFF_SQL} SELECT * FROM diff",
    "chunk_diff": f"WITH {_DIFF_SQL}, {_CHUNK_DIFF_SQL} SELECT * FROM cdiff",
    "deleted_files": f"WITH {_DIFF_SQL} SELECT path FROM diff WHERE status = 'deleted'",
    "staleness_count": f"""WITH {FILES_SQL}, {MANIFEST_SQL}, {PRESENT_SQL}, j AS (SELECT f.mtime AS fm, m.mtime AS mm FROM present f FULL JOIN manifest m ON f.path = m.path)
      SELECT count(*) FILTER (mm IS NULL) AS n_new, count(*) FILTER (fm <> mm) AS n_modified, count(*) FILTER (fm IS NULL) AS n_deleted, count(*) FILTER (mm IS NULL OR fm IS NULL OR fm <> mm) AS n_stale FROM j""",
    "status_rollup": STATUS_SQL,
    "index_stats": STATS_SQL,
    "apply_upsert": UPSERT_SQL,
    "apply_remove": REMOVE_SQL,
    "scalar_misc": SCALAR_SQL,
}
