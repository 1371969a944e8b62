"""op1: documents that hold a benchmark item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import read_table
from skerry.llm.decontaminate import leaks


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, similarity, start): one row for each document and item that it leaks."""
    got = leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    best = got.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
    return best.select("doc_id", "item_id", "best.similarity", (-F.col("best.back")).alias("start"))


_SH = "CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"

#: Every window that begins with a shared shingle, with every end; no fingerprints, so it also shows that the index loses none.
OP1_SQL = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}]+') AS w FROM documents), ds AS (SELECT doc_id, {_SH} AS s FROM dw),
dsh AS (SELECT doc_id, unnest(s) AS h, generate_subscripts(s, 1) - 1 AS pos FROM ds),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}]+') AS w FROM benchmark), its AS (SELECT item_id, {_SH} AS s FROM iw),
ish AS (SELECT item_id, m, h, count(*) AS c FROM (SELECT item_id, len(s) AS m, unnest(s) AS h FROM its) GROUP BY ALL),
hits AS (SELECT DISTINCT doc_id, item_id, m, pos, h, c FROM dsh JOIN ish USING (h)),
inside AS (SELECT a.doc_id, a.item_id, a.m, a.pos AS start, y.pos, y.c, row_number() OVER (PARTITION BY a.doc_id, a.item_id, a.pos, y.h ORDER BY y.pos) AS nth
  FROM hits a JOIN hits y ON y.doc_id = a.doc_id AND y.item_id = a.item_id AND y.pos >= a.pos AND y.pos < a.pos + ceil(a.m / 0.8)),
sums AS (SELECT doc_id, item_id, m, start, pos, count(*) OVER (PARTITION BY doc_id, item_id, start ORDER BY pos) AS shared FROM inside WHERE nth <= c),
sims AS (SELECT doc_id, item_id, start, (shared / (m + pos - start + 1 - shared))::DOUBLE AS similarity FROM sums)
SELECT doc_id, item_id, similarity, start FROM sims WHERE similarity >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1"""
