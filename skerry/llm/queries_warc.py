"""op9: pages as WARC records in seekable bundles, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skerry.llm.common import read_table
from skerry.llm.warc import write_and_read


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = write_and_read(read_table(spark, sf_dir, "pages"), least_bytes=0)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_BASE32 = "array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT, 1)), '')"

OP9_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages), q AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to FROM q"""
