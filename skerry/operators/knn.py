"""Exact nearest neighbours by cosine distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors of one block; more are answered block by block.
BLOCK = 1024
#: Rows of the corpus that meet a block at a time, and pairs that are measured at a time: a task's memory follows from these, whatever its batches hold.
TILE, PAIRS = 1024, 16_384
_SLACK = 1e-12


def _search(ids: list, vectors: np.ndarray, k: int, number: bool, tile: int = TILE, pairs: int = PAIRS):
    """``number``: whether the corpus's ids are numbers, else they are strings; both order as Spark orders them.

    A product of matrices finds who can be among the k nearest; each such pair is
    then measured by itself, so that equal vectors lie at equal distances
    wherever they stand, and ties stay ties.
    """
    kind = np.int64 if number else np.str_
    length = np.maximum(np.linalg.norm(vectors, axis=1), 1e-300)
    unit = vectors / length[:, None]

    def distances(who: np.ndarray, x: np.ndarray, norm: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(who))
        for lo in range(0, len(who), pairs):
            w, i = who[lo : lo + pairs], at[lo : lo + pairs]
            out[lo : lo + pairs] = 1 - (vectors[w] * x[i]).sum(axis=1) / (length[w] * norm[i])
        return out

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the best so far, by query, distance and id, and what may be among them
        best_q, best_d, best_i = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, kind)
        more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        far = np.full(len(ids), np.inf)

        def settle() -> None:
            nonlocal best_q, best_d, best_i
            q, d, i = (np.concatenate(c) for c in zip((best_q, best_d, best_i), *more, strict=True))
            more.clear()
            by = np.lexsort((i, d, q))
            q, d, i = q[by], d[by], i[by]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            last = place == k - 1
            far[q[last]] = d[last]
            best_q, best_d, best_i = (c[place < k] for c in (q, d, i))

        for b in it:
            for lo in range(0, b.num_rows, tile):
                part = b.slice(lo, tile)
                x = np.asarray(part.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(part.num_rows, -1)
                norm = np.sqrt((x * x).sum(axis=1))
                ok = np.flatnonzero(np.isfinite(norm) & (norm > 0))
                if not len(ok):
                    continue
                x, norm = x[ok], norm[ok]
                d = unit @ (x / norm[:, None]).T
                np.subtract(1, d, out=d)
                within = np.minimum(far, np.partition(d, k - 1, axis=1)[:, k - 1]) if len(ok) >= k else far
                who, at = np.nonzero(d <= within[:, None] + _SLACK)
                del d
                if len(who):
                    more.append((who, distances(who, x, norm, at), np.asarray(part.column(0).take(pa.array(ok)).to_pylist(), kind)[at]))
                if sum(len(m[0]) for m in more) > k * len(ids):
                    settle()
        if more:
            settle()
        if len(best_q):
            yield pa.RecordBatch.from_arrays([pa.array(ids).take(pa.array(best_q)), pa.array(best_i.tolist(), pa.int64() if number else pa.string()), pa.array(best_d)], ["qid", "id", "distance"])

    return run


def knn(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, where: str | None = None, query_id_col: str | None = None) -> DataFrame:
    """(qid, id, distance, rank): the k nearest rows of ``corpus`` to each row of ``queries``; ties by id, a number or a string.

    Queries go to the executors in blocks of ``block`` vectors, each task keeps
    its own best k of a query, so tasks times queries times k rows are shuffled
    whatever the corpus holds, and its memory doesn't grow with its batches. Null and zero vectors are no one's neighbours.
    ``where`` is a condition in SQL on the corpus's columns, met before the search.
    """
    corpus = corpus.filter(where) if where else corpus
    found = None
    rows: list = []
    part = queries.select(F.col(query_id_col or id_col).alias("q"), F.col(vec_col).alias("v")).filter("v is not null")
    number = corpus.schema[id_col].dataType.simpleString() != "string"
    kind = "long" if number else "string"
    data = corpus.select(F.col(id_col).cast(kind).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter("v is not null")

    q_kind = part.schema["q"].dataType.simpleString()

    def add(out: DataFrame | None) -> DataFrame:
        more = data.mapInArrow(_search([r["q"] for r in rows], np.array([list(r["v"]) for r in rows], np.float64), k, number), f"qid {q_kind}, id {kind}, distance double")
        return more if out is None else out.unionByName(more)

    for r in part.toLocalIterator():
        rows.append(r)
        if len(rows) == block:
            found, rows = add(found), []
    if rows or found is None:
        found = add(found) if rows else data.select(F.lit(None).cast(q_kind).alias("qid"), "id", F.lit(0.0).alias("distance")).limit(0)
    order = Window.partitionBy("qid").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_score(distance: str = "distance"):
    """1 - distance, within 0 and 1, to four decimals."""
    return F.floor(F.least(F.greatest(1 - F.col(distance), F.lit(0.0)), F.lit(1.0)) * 10000 + 0.5) / 10000


def image_score(distance: str = "distance"):
    """Similarity between texts and images rescaled from its narrow band, 0.15 to 0.40."""
    return F.floor(F.least(F.greatest((1 - F.col(distance) - 0.15) / 0.25, F.lit(0.0)), F.lit(1.0)) * 10000 + 0.5) / 10000
