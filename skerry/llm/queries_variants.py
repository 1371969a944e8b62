"""op12: spelling variants of the documents' words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skerry.llm.common import read_table
from skerry.llm.variants import frequent, variants, words

RUNS = "[A-Za-zÀ-ÿ]+"
LEAST_CHARS, LEAST_N, EDIT = 6, 5, 199


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = words(read_table(spark, sf_dir, "documents"), RUNS, edit=EDIT, least_chars=LEAST_CHARS)
    return variants(frequent(got, LEAST_N))


_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, x: CASE WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"
_BYTES = "list_transform(range(0, len(hex({t})) // 2), lambda i: ('0x' || substr(hex({t}), (2 * i + 1)::INT, 2))::BIGINT)"
_CRC = f"xor(4294967295, list_reduce(list_prepend(4294967295, {_BYTES.format(t='k')}), lambda a, b: xor(a >> 8, tab[(1 + (xor(a, b) & 255))::INT])))"

#: Words one replacement apart share the word with that place left out and its number; one is a deletion of the other otherwise.
OP12_SQL = f"""
WITH RECURSIVE runs AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' AS id, translate(unnest(regexp_extract_all(text, '{RUNS}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
each_run AS (SELECT id || w AS k, w, count(*) AS c FROM runs GROUP BY ALL), tab AS MATERIALIZED (SELECT {_CRC_TABLE} AS tab),
hashed AS (SELECT w, c, {_CRC} AS h FROM each_run, tab),
edited AS (SELECT CASE WHEN h % {EDIT} = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, c FROM hashed),
vocab AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM edited WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(c) >= {LEAST_N}),
gaps AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab), holes AS (SELECT word, n, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM gaps),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN vocab b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM holes a JOIN vocab b ON a.rest = b.word),
per AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS best, max(near_n) AS best_n FROM pairs GROUP BY word),
got AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM vocab LEFT JOIN per USING (word)),
walk AS (SELECT word, word AS at FROM got UNION ALL SELECT w.word, g.form FROM walk w JOIN got g ON g.word = w.at WHERE g.form IS NOT NULL),
roots AS (SELECT w.word, w.at AS root FROM walk w JOIN got g ON g.word = w.at WHERE g.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM got JOIN roots USING (word)"""
