"""Times headline queries and prints one JSON line.

BENCH_SF_DIR: tables (default /root/testdata/sf0.1); BENCH_CPUS: threads.
Every query runs once unmeasured on the smallest tables, so that times don't
hold the compilation of code, then once measured, its rows written to nowhere.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from skerry import api  # noqa: E402
from skerry.operators import blocks, fusion, lexical  # noqa: E402
from skerry.plans import registry  # noqa: E402
from skerry.sources.shared import kept  # noqa: E402
from skerry.sources.synthetic import text_file  # noqa: E402
from skerry.sources.tables import spread, table  # noqa: E402

NAMES = (
    "code_tokens_tf bm25_topk bm25_prefix_topk keyword_normalized knn_cosine_topk knn_lists rrf_fuse hybrid_query hybrid_vectors collapse_adjacent paragraph_chunks sentence_split token_windows manifest_diff chunk_diff "
    "index_stats staleness_count apply_upsert ir_metrics latency_percentiles"
).split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "4m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda f, d: f(spark, d).write.mode("overwrite").format("noop").save()
    warm = os.path.join(os.path.dirname(os.path.normpath(sf)), "sf0.001")
    times = {}
    for name in NAMES:
        if os.path.isdir(warm):
            run(registry.QUERIES[name], warm)
        began = time.time()
        run(registry.QUERIES[name], sf)
        times[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()  # else the next query rides on this one's postings
    rates = keyword_rates(spark, sf) | {"chunked_files_per_s": round(table(spark, sf, "documents").count() / times["paragraph_chunks"])} | reindex_rates(spark) | fusion_rate(spark)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(os.path.normpath(sf)), "rates": rates}))


def noop(df) -> float:
    began = time.time()
    df.write.mode("overwrite").format("noop").save()
    return time.time() - began


def keyword_rates(spark, sf: str) -> dict:
    """An index that is built and stored once answers a batch of queries, prefixes expanded."""
    began = time.time()
    index = kept(blocks.build(spread(table(spark, sf, "documents").select("doc_id", "text"))))
    build = time.time() - began
    terms = lexical.query_terms(table(spark, sf, "benchmark"), "item_id", "text")
    noop(blocks.search(index, terms, 10))
    began = time.time()
    noop(blocks.search(index, terms, 10))
    rate = table(spark, sf, "benchmark").count() / (time.time() - began)
    got = blocks.search(index, terms, 10, counted=True).agg(F.sum("scored").alias("scored"), F.sum("asked").alias("asked")).first()
    return {"index_build_s": round(build, 3), "keyword_queries_per_s": round(rate, 1), "postings_scored": got["scored"], "postings_asked": got["asked"]}


def reindex_rates(spark, n: int = 1000) -> dict:
    """How many times faster an index of n files is brought up to date than built, by the share of files that changed; no embedding."""
    root = tempfile.mkdtemp(prefix="skerry-bench-")
    write = lambda i, seed: open(os.path.join(root, f"f{i}.md"), "w").write(text_file(4000, seed))  # noqa: E731, SIM115
    for i in range(n):
        write(i, i)
    timed = lambda: (time.time(), api.index(spark, root), time.time())
    timed()
    api._store(spark, root).clear()
    began, _, ended = timed()
    full, out = ended - began, {"index_1000_files_s": round(ended - began, 2)}
    for share in (0.1, 0.25, 0.5):
        for i in range(int(n * share)):
            write(i, n + i + int(share * 1e6))
        began, _, ended = timed()
        out[f"reindex_speedup_{round(100 * share)}"] = round(full / (ended - began), 2)
    return out


def fusion_rate(spark, queries: int = 200, items: int = 1000) -> dict:
    """Fusion of two rankings, half of whose ids are common, over a sort of one of them."""
    rank = spark.range(queries * items).select((F.col("id") / items).cast("long").alias("qid"), (F.col("id") % items + 1).alias("rank"))
    left, right = (kept(rank.withColumn("id", F.col("rank") * 7919 % items + shift)) for shift in (0, items // 2))
    sort = lambda: noop(lexical.first_k(left, items, ["rank"]))
    fuse = lambda: noop(fusion.rrf(left, right))
    sort(), fuse()
    return {"fusion_over_sort": round(fuse() / sort(), 2)}


if __name__ == "__main__":
    main()
