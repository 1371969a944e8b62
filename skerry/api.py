"""Index, query and status of a folder of files."""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.errors import EngineError
from skerry.functions.text import content_hash
from skerry.operators import fusion, knn, lexical, manifest, results
from skerry.operators.chunking import Tokenizer, all_chunks
from skerry.operators.embedding import PREFIXES, Embedder, embed_chunks, ensemble
from skerry.sources import pdf
from skerry.sources.files import STORE, read_contents, scan
from skerry.sources.store import SCHEMAS, Store

MODES = ("hybrid", "semantic", "keyword")
TYPES = manifest.TYPES


Progress = Callable[[str, int, int | None], None]


@contextmanager
def watched(look: Callable[[], None], every: float = 0.5) -> Iterator[None]:
    """Calls ``look`` again and again while the block runs, and once after it."""
    over = threading.Event()

    def run() -> None:
        while not over.wait(every):
            look()

    t = threading.Thread(target=run, daemon=True)
    t.start()
    try:
        yield
    finally:
        over.set()
        t.join()
        look()


def _store(spark: SparkSession, folder: str) -> Store:
    return Store(spark, os.path.join(os.path.abspath(folder), STORE))


def _checked_type(kind: str | None) -> None:
    if kind is not None and kind not in TYPES:
        raise EngineError("UNSUPPORTED_TYPE", f"Unknown type: {kind}", f"Use one of {', '.join(TYPES)}")


def index(
    spark: SparkSession, path: str, ignore: bool = True, type: str | None = None, clear: bool = False, embedder: Embedder | None = None, image_embedder: Embedder | None = None,
    pdf_reader: pdf.Reader | None = None, tokenizer: Tokenizer | None = None, progress: Progress | None = None,
) -> dict:
    """Brings the index of ``path`` up to date and returns the counters.

    Only files whose time or size changed are read, only those whose hash
    changed are cut into chunks, and only chunks whose text changed are
    embedded. What changed is saved at the end, in all tables together. PDF files
    need a reader; without one, or where it fails, they have no chunks.
    ``tokenizer`` cuts code into tokens: from a text to their places. ``progress`` is called with a stage, how much of
    it is done and how much there is (None where that isn't known); chunks are counted as tasks embed them.
    """
    began = time.time()
    tell = progress or (lambda stage, done, total: None)
    _checked_type(type)
    store = _store(spark, path)
    if clear:
        store.clear()
    old_all = store.load("manifest")
    mine = F.lit(True) if type is None else F.col("type") == type
    old = old_all.filter(mine)
    found = scan(spark, path, ignore, type).cache()
    if found.isEmpty() and old.isEmpty():
        raise EngineError("EMPTY_DIR", f"No files to index in {path}", "Check the path and the ignore rules")

    tell("scanned", found.count(), None)
    seen = old.select("path", F.col("mtime").alias("m_mtime"), F.col("size").alias("m_size"), "hash")
    fresh = found.join(seen, "path", "left")
    same = (F.col("mtime") == F.col("m_mtime")) & (F.col("size") == F.col("m_size"))
    unread = fresh.filter(F.coalesce(same, F.lit(False))).select("path", "type", "size", "mtime", "hash")
    read = read_contents(fresh.filter(~F.coalesce(same, F.lit(False))).select("path", "abs_path", "type", "size", "mtime")).cache()
    now = unread.unionByName(read.select("path", "type", "size", "mtime", content_hash(F.col("content")).alias("hash"))).cache()
    diff = manifest.diff_files(now, old).cache()

    changed = diff.filter(F.col("status").isin("new", "changed")).select("path")
    text = F.when(F.col("type") == "image", "").otherwise(F.make_valid_utf8(F.col("content").cast("string")))
    todo_files = read.join(changed, "path", "left_semi")
    is_pdf = F.lower("path").endswith(".pdf")
    texts = todo_files.filter(~is_pdf).select("path", "type", text.alias("text")).unionByName(pdf.with_text(todo_files.filter(is_pdf), pdf_reader or pdf.default_reader()))
    new_chunks = all_chunks(texts, tokenizer).cache()
    stale = diff.filter(F.col("status").isin("new", "changed", "deleted")).select("path")
    old_chunks = store.load("chunks")
    in_type = old_chunks.filter(mine)
    chunk_diff = manifest.diff_chunks(new_chunks, in_type.join(stale, "path", "left_semi"))
    stats = manifest.index_stats(diff, chunk_diff).first().asDict()

    tell("files", stats["files_indexed"], stats["files_indexed"])
    tell("chunks", stats["chunks_created"], stats["chunks_created"] + stats["chunks_reused"])
    embedded = spark.sparkContext.accumulator(0)
    posts = lexical.postings(new_chunks.filter("type <> 'image'"), "id", "chunk_text").withColumnRenamed("doc_id", "id").join(new_chunks.select("id", "path"), "id")
    old_vectors, vectors = store.load("vectors"), spark.createDataFrame([], SCHEMAS["vectors"])
    for kinds, model in ((("code", "text"), embedder), (("image",), image_embedder)):
        if model is not None:
            wanted = new_chunks.filter(F.col("type").isin(*kinds))
            reuse = old_vectors.filter(F.col("model_id") == model.model_id).join(wanted.select("id", "text_hash"), ["id", "text_hash"], "left_semi")
            if kinds == ("image",):
                reuse = reuse.limit(0)  # an image's text is empty; its bytes changed
            todo = wanted.join(reuse.select("id"), "id", "left_anti")
            if kinds == ("image",):
                fresh_vectors = embed_chunks(todo.join(read.select("path", "content"), "path"), model, "content", embedded)
            else:
                fresh_vectors = embed_chunks(todo, model, counted=embedded)
            vectors = vectors.unionByName(reuse).unionByName(fresh_vectors)
    # only files that aren't as they were: those that were touched keep their chunks
    moved = diff.filter("status <> 'unchanged'")
    per_file = new_chunks.groupBy("path").agg(F.count(F.lit(1)).alias("n_new"))
    before = old.select("path", F.col("n_chunks").alias("n_old"))
    entries = now.join(moved, "path").join(per_file, "path", "left").join(before, "path", "left")
    entries = entries.withColumn("n_chunks", F.when(F.col("status") == "touched", F.coalesce("n_old", F.lit(0))).otherwise(F.coalesce("n_new", F.lit(0))))
    added = {"manifest": entries, "chunks": new_chunks, "postings": posts, "vectors": vectors}
    with watched(lambda: tell("embedded", embedded.value, None)) if embedder or image_embedder else nullcontext():
        store.save(added, {"manifest": moved, "chunks": stale, "postings": stale, "vectors": stale}, time.time())
    tell("saved", 1, 1)
    for df in (found, read, now, diff, new_chunks):
        df.unpersist()
    return {"status": "ok", "path": os.path.abspath(path), **stats, "duration_ms": round((time.time() - began) * 1000), "storage_dir": store.folder}


def _stale(spark: SparkSession, path: str, store: Store, ignore: bool = True) -> int:
    return manifest.staleness(scan(spark, path, ignore), store.load("manifest")).first()["n_stale"]


def _query_vector(spark: SparkSession, vector) -> DataFrame:
    return spark.createDataFrame([(0, [float(x) for x in vector])], "vec_id long, embedding array<double>")


def _nearest(spark: SparkSession, vectors: DataFrame, vector, k: int) -> DataFrame:
    """(qid, id, distance, rank) with the chunk's own id."""
    return knn.knn(vectors, _query_vector(spark, vector), k, id_col="id", query_id_col="vec_id")


def search(
    spark: SparkSession, store: Store, text: str, kind: str, mode: str, k: int, threshold: float | None, dir: str | None, embedder: Embedder | None, pooled: bool = False
) -> DataFrame:
    """Collapsed results (file_path, line_start, line_end, score, chunk_text, rank) of one type.

    A folder's chunks are ranked among themselves, with the whole type's term statistics. ``pooled`` ranks code and
    text together and keeps the type's chunks of what was fetched: fewer results where the other type ranks better.
    """
    kinds = ("code", "text") if pooled else (kind,)
    fetch = results.over_fetch(k, threshold is not None or dir is not None)
    chunks = store.load("chunks").filter(F.col("type").isin(*kinds))
    inside = chunks if dir is None else chunks.filter(results.in_folder(F.col("path"), dir))
    row = inside.filter(F.col("type") == kind).select("id", F.col("path").alias("file_path"), "chunk_index", "line_start", "line_end", "chunk_text")
    sem = lex = None
    if mode != "keyword" and embedder is not None:
        own = store.load("vectors").filter(F.col("type").isin(*kinds) & (F.col("model_id") == embedder.model_id))
        own = own if dir is None else own.join(inside.select("id"), "id", "left_semi")
        sem = _nearest(spark, own, embedder.embed([PREFIXES[kind] + text])[0], fetch).withColumn("score", knn.search_score())
    if mode != "semantic":
        post = store.load("postings").drop("path").join(chunks.select("id"), "id", "left_semi").withColumnRenamed("id", "doc_id")
        terms = lexical.query_terms(spark.createDataFrame([(0, text)], "qid long, query string"))
        hits = lexical.bm25(post, lexical.expand_prefixes(post.select("term").distinct(), terms))
        if dir is not None:
            hits = hits.join(inside.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
        lex = lexical.relative(lexical.top_k(hits, fetch)).withColumnRenamed("doc_id", "id")
    if sem is not None and lex is not None and not sem.isEmpty() and not lex.isEmpty():
        ranked = fusion.rrf(sem.select("qid", "id", "rank"), lex.select("qid", "id", "rank")).select("qid", "id", "score")
    else:
        ranked = (sem if lex is None or (sem is not None and lex.isEmpty()) else lex)
        if ranked is None:
            ranked = spark.createDataFrame([], "qid long, id string, score double")
        ranked = ranked.select("qid", "id", "score")
    return results.filter_and_collapse(ranked.join(row, "id"), k, threshold=threshold, dir=dir)


def query(
    spark: SparkSession, text: str, project_dir: str = ".", top_k: int = 10, dir: str | None = None, threshold: float | None = None, type: str | None = None, mode: str = "hybrid",
    auto_index: bool = True, embedder: Embedder | None = None, image_embedder: Embedder | None = None, pooled: bool = False,
) -> dict:
    """Answers a query; the envelope has results for code, text and image. ``pooled``: see ``search``."""
    if mode not in MODES:
        raise EngineError("INVALID_MODE", f"Invalid mode: {mode}", f"Use one of {', '.join(MODES)}")
    _checked_type(type)
    if not isinstance(top_k, int) or top_k < 1:
        raise EngineError("GENERAL_ERROR", f"top_k is a whole number above 0, not {top_k!r}")
    store = _store(spark, project_dir)
    indexing = None
    entries = store.load("manifest")
    if entries.isEmpty():
        if not auto_index:
            raise EngineError("NO_INDEX", f"No index in {project_dir}", "Index the folder first")
        indexing = index(spark, project_dir, embedder=embedder, image_embedder=image_embedder)
        entries = store.load("manifest")
    by_type = {r["type"]: r["n"] for r in entries.groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()}
    if type is not None and type not in by_type:
        raise EngineError("NO_INDEX", f"No {type} files are indexed", "Index files of this type first")
    stale = 0 if indexing else _stale(spark, project_dir, store)
    effective, warning = mode, None
    if mode != "semantic" and not store.has("postings"):
        effective, warning = "semantic", "No keyword index: falling back to semantic search. Index the folder again for keyword and hybrid search"
    if effective == "hybrid" and embedder is None:
        effective = "keyword"
    if effective == "semantic" and embedder is None and (image_embedder is None or type in ("code", "text")):
        raise EngineError("GENERAL_ERROR", f"Semantic search needs an embedder{': the keyword index is missing' if warning else ''}", "Name one (--model), or use keyword mode")
    out: dict = {"query": text, "total_indexed": sum(by_type.values()), "search_scope": dir or ".", "mode": effective, "code": [], "text": [], "image": []}
    for kind in ("code", "text"):
        if kind in by_type and type in (None, kind):
            for r in search(spark, store, text, kind, effective, top_k, threshold, dir, embedder, pooled).orderBy("rank").collect():
                item = {"file": r["file_path"], "score": r["score"], "text": r["chunk_text"]}
                if kind == "code":
                    item["lines"] = {"start": r["line_start"], "end": r["line_end"]}
                out[kind].append(item)
    if "image" in by_type and type in (None, "image") and effective != "keyword" and image_embedder is not None:
        own = store.load("vectors").filter((F.col("type") == "image") & (F.col("model_id") == image_embedder.model_id))
        own = own if dir is None else own.filter(results.in_folder(F.col("path"), dir))
        near = _nearest(spark, own, ensemble(image_embedder, text), results.over_fetch(top_k, threshold is not None or dir is not None))
        rows = near.join(own.select("id", F.col("path").alias("file_path")), "id").withColumn("score", knn.image_score())
        out["image"] = [{"file": r["file_path"], "score": r["score"]} for r in results.image_results(rows, top_k, threshold=threshold, dir=dir).orderBy("rank").collect()]
    if indexing:
        out["indexing"] = {"status": indexing["status"], "files_indexed": indexing["files_indexed"], "duration_ms": indexing["duration_ms"]}
    if warning:
        out["warning"] = warning
    if stale:
        out["stale"], out["stale_file_count"] = True, stale
    return out


def status(spark: SparkSession, project_dir: str = ".", ignore: bool = True) -> dict:
    """Counts by type, size, time and staleness of the index."""
    store = _store(spark, project_dir)
    if not store.files.exists():
        raise EngineError("NO_INDEX", f"No index in {project_dir}", "Index the folder first")
    if store.broken:
        raise EngineError("CORRUPT_MANIFEST", "The index can't be read", "Index the folder again with clear")
    roll = {r["type"]: {"files": r["files"], "chunks": r["chunks"]} for r in manifest.status_rollup(store.load("manifest")).collect()}
    models = [r["model_id"] for r in store.load("vectors").select("model_id").distinct().orderBy("model_id").collect()]
    at = store.saved_at
    return {
        "file_count": sum(x["files"] for x in roll.values()), "chunk_count": sum(x["chunks"] for x in roll.values()),
        "last_indexed": datetime.fromtimestamp(at, UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z") if at else None, "model_types": models,
        "index_size_bytes": store.size(), "storage_path": store.folder, "stale_file_count": _stale(spark, project_dir, store, ignore), "by_type": roll,
    }
