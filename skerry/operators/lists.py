"""Nearest neighbours by inverted lists: vectors stored by their nearest centroid, a query reads few lists.

Centroids are trained by Spark's k-means on a bounded sample; every vector is
indexed. A search reads the lists of the nearest centroids and ranks what they
hold by exact distance. ``exact`` goes on to each list that could still hold a
nearer vector, by the angle between query and centroid and the list's width, so
nothing is lost; without it a few neighbours may be.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators import lexical
from skerry.sources.shared import kept, ship

#: Vectors that the centroids are trained on at most: those of the smallest hashes of their ids.
SAMPLE = 50_000
#: Vectors of a part (a list that holds more has several, whatever makes it large) and queries of a chunk: they bound a task's memory.
PART, CHUNK = 20_000, 8_192
#: Numbers of a matrix of angles or distances, and vectors that a task writes at a time.
CELLS, OUT = 1 << 20, 8_192
_SLACK = 1e-9


@dataclass(frozen=True)
class Lists:
    """``vectors`` (list, part, id, v: at unit length) by ``centroids``, with each list's number of vectors and its width (the greatest angle to the centroid)."""

    vectors: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray
    widths: np.ndarray

    @property
    def parts(self) -> np.ndarray:
        return _parts(self.sizes)


def _parts(sizes: np.ndarray) -> np.ndarray:
    return np.maximum(1, -(-sizes // PART))


def _n(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def _unit(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the vectors at unit length, which rows have one: null, zero and infinite vectors have none)."""
    keep = np.flatnonzero(col.is_valid().to_numpy(zero_copy_only=False))
    got = col.take(pa.array(keep))
    x = np.asarray(got.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(keep), -1)
    with np.errstate(invalid="ignore", divide="ignore"):
        x = x / np.linalg.norm(x, axis=1)[:, None]
    ok = np.isfinite(x).all(axis=1)
    return x[ok], keep[ok]


def _slabs(b: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose rows by ``width`` columns make a matrix of bounded size."""
    step = max(1, CELLS // max(1, width))
    return (b.slice(lo, step) for lo in range(0, b.num_rows, step))


def _angle(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1, 1))


def _rows(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1] or 1, dtype=np.int32) if x.size else np.zeros(len(x) + 1, np.int32)), pa.array(x.ravel()))


def fit(corpus: DataFrame, lists: int, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE, seed: int = 7, rounds: int = 10) -> np.ndarray:
    """Centroids at unit length, ``lists`` or fewer, from at most ``sample`` vectors; none without any vector."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = F.col(vec_col).cast("array<double>")
    usable = corpus.select(F.col(id_col).alias("id"), v.alias("v")).filter("v is not null and exists(v, x -> x <> 0)")
    some = usable.orderBy(F.xxhash64("id"), "id").limit(sample).select(array_to_vector("v").alias("features")).persist()
    try:
        if some.isEmpty():
            return np.zeros((0, 0))
        centers = np.array(KMeans(k=lists, distanceMeasure="cosine", maxIter=rounds, seed=seed, initMode="random").fit(some).clusterCenters())
    finally:
        some.unpersist()
    return centers / np.linalg.norm(centers, axis=1, keepdims=True)


def build(corpus: DataFrame, centroids: np.ndarray, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(list, id, v, angle) of every vector that has a direction; null and zero vectors have none and are no one's neighbours."""
    ship(corpus.sparkSession)
    data = corpus.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    schema = f"list int, id {data.schema['id'].dataType.simpleString()}, v array<double>, angle double"
    if not len(centroids):
        return corpus.sparkSession.createDataFrame([], schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in it for s in _slabs(whole, len(centroids))):
            x, keep = _unit(b.column(1))
            if len(keep):
                cos = x @ centroids.T
                at = cos.argmax(axis=1)
                yield _rows(["list", "id", "v", "angle"], at.astype(np.int32), b.column(0).take(pa.array(keep)), _vectors(x), _angle(cos[np.arange(len(at)), at]))

    return data.mapInArrow(run, schema)


def write(built: DataFrame, centroids: np.ndarray, path: str) -> None:
    """Stores an index: vectors in a folder for each list, so that a search reads its lists alone, and the centroids."""
    spark = built.sparkSession
    built.write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")
    stored = spark.read.schema(built.schema).parquet(f"{path}/vectors")
    of = stored.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("width"))
    rows = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "list int, centroid array<double>")
    rows.join(of, "list", "left").na.fill(0, ["n"]).na.fill(0.0, ["width"]).write.mode("overwrite").parquet(f"{path}/centroids")


def read(spark: SparkSession, path: str, id_type: str = "bigint") -> Lists:
    rows = sorted(spark.read.schema("list int, centroid array<double>, n long, width double").parquet(f"{path}/centroids").collect())
    sizes = np.array([r["n"] for r in rows], np.int64)
    vectors = spark.read.schema(f"list int, id {id_type}, v array<double>, angle double").parquet(f"{path}/vectors")
    parts = F.element_at(F.lit([int(x) for x in _parts(sizes)] or [1]).cast("array<int>"), F.col("list") + 1)
    return Lists(vectors.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")), np.array([r["centroid"] for r in rows]), sizes, np.array([r["width"] for r in rows]))


def _wanted(index: Lists, queries: DataFrame, chunks: int, probes: int) -> DataFrame:
    """(list, part, chunk, qid, q) of the lists that each query (qid, v) reads.

    Without a column ``far``: the ``probes`` nearest. With it, the distance of
    the k-th neighbour so far: all others that may hold a nearer one.
    """
    ship(queries.sparkSession)
    centroids, parts, widths, used = index.centroids, index.parts, index.widths, np.flatnonzero(index.sizes)
    later = "far" in queries.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in it for s in _slabs(whole, len(used))):
            x, keep = _unit(b.column(1))
            if not len(keep):
                continue
            cos = x @ centroids[used].T
            first = np.zeros(cos.shape, bool)
            np.put_along_axis(first, np.argsort(-cos, axis=1, kind="stable")[:, :probes], True, axis=1)
            if later:
                far = b.column(2).to_numpy(zero_copy_only=False)[keep]
                least = np.maximum(_angle(cos) - widths[used], 0)
                first = ~first & (least <= _angle(1 - far)[:, None] + _SLACK)
            who, at = np.nonzero(first)
            n = parts[used[at]]
            who, at = np.repeat(who, n), np.repeat(used[at], n)
            part = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            # a query that reads many lists has as many rows, with its vector in each
            for lo in range(0, len(who), OUT):
                w = who[lo : lo + OUT]
                ids = b.column(0).take(pa.array(keep[w]))
                yield _rows(["list", "part", "qid", "q"], at[lo : lo + OUT].astype(np.int32), part[lo : lo + OUT].astype(np.int32), ids, _vectors(x[w]))

    q_type = queries.schema["qid"].dataType.simpleString()
    got = queries.select("qid", "v", *(["far"] if later else [])).mapInArrow(run, f"list int, part int, qid {q_type}, q array<double>")
    return got.withColumn("chunk", F.pmod(F.xxhash64("qid"), F.lit(chunks)).cast("int"))


def _nearest(index: Lists, wanted: DataFrame, chunks: int, k: int) -> DataFrame:
    """(qid, id, distance): the best k of each part of a list for each query that reads it."""
    spark = wanted.sparkSession
    asked = [r["list"] for r in wanted.select("list").distinct().collect()]
    vectors = index.vectors.filter(F.col("list").isin(asked) if asked else F.lit(False)).select("list", "part", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "id", "v")
    q_type, id_type = wanted.schema["qid"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    key = ["list", "part", "chunk"]
    empty = pa.schema([("qid", pa.null()), ("id", pa.null()), ("distance", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            kinds = [(left.schema.field("qid").type if left.num_columns else pa.null()), (right.schema.field("id").type if right.num_columns else pa.null()), pa.float64()]
            return pa.schema(list(zip(empty.names, kinds, strict=True))).empty_table()
        mat = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        q, v = mat(left, "q"), mat(right, "v")
        order = right.column("id").combine_chunks()
        # ids in ascending order: a stable sort by distance then breaks ties by id
        by = np.asarray(pa.compute.sort_indices(order))
        v, order = v[by], order.take(pa.array(by))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = max(1, CELLS // len(v))
        for lo in range(0, len(q), step):
            d = 1 - q[lo : lo + step] @ v.T
            at = np.argsort(d, axis=1, kind="stable")[:, :k]
            out.append((np.repeat(np.arange(lo, lo + len(d)), at.shape[1]), at.ravel(), np.take_along_axis(d, at, 1).ravel()))
        who, at, dist = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"qid": left.column("qid").combine_chunks().take(pa.array(who)), "id": order.take(pa.array(at)), "distance": dist})

    # numbers of their own: groups cost far more than their bytes tell
    n = _n(spark)
    pair = wanted.repartition(n, *key).groupBy(*key).cogroup(vectors.repartition(n, *key).groupBy(*key))
    return pair.applyInArrow(run, f"qid {q_type}, id {id_type}, distance double")


def search(index: Lists, queries: DataFrame, k: int, probes: int = 8, exact: bool = False, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(qid, id, distance, rank): the k nearest that the ``probes`` nearest lists of each query hold; ties by id.

    With ``exact`` also those of every other list whose bound is below the k-th
    distance found: the same rows as a search of everything. Queries without a
    direction have no neighbours.
    """
    spark = queries.sparkSession
    q = queries.select(F.col(id_col).alias("qid"), F.col(vec_col).cast("array<double>").alias("v")).filter("v is not null")
    order = ["distance", "id"]
    if not index.sizes.sum():
        none = spark.createDataFrame([], f"qid {q.schema['qid'].dataType.simpleString()}, id {index.vectors.schema['id'].dataType.simpleString()}, distance double")
        return lexical.first_k(none, k, order)
    chunks = max(1, -(-q.count() // CHUNK))
    found = _nearest(index, _wanted(index, q, chunks, probes), chunks, k)
    if exact:
        found = kept(lexical.first_k(found, k, order).drop("rank"))
        # with fewer than k neighbours so far nothing is too far
        far = found.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("d")).select("qid", F.when(F.col("n") == k, F.col("d")).otherwise(2.0).alias("far"))
        rest = q.join(far, "qid", "left").select("qid", "v", F.coalesce("far", F.lit(2.0)).alias("far"))
        found = found.unionByName(_nearest(index, _wanted(index, rest, chunks, probes), chunks, k))
    return lexical.first_k(found, k, order)


def share_read(index: Lists, queries: DataFrame, probes: int, id_col: str = "vec_id", vec_col: str = "embedding") -> float:
    """The mean share of all vectors that a query's first lists hold."""
    q = queries.select(F.col(id_col).alias("qid"), F.col(vec_col).cast("array<double>").alias("v")).filter("v is not null")
    per_part = index.vectors.groupBy("list", "part").agg(F.count(F.lit(1)).alias("n"))
    got = _wanted(index, q, 1, probes).join(per_part, ["list", "part"]).agg(F.sum("n").alias("n"), F.count_distinct("qid").alias("q")).first()
    return got["n"] / (got["q"] * index.sizes.sum()) if got["q"] else 0.0


def recall(index: Lists, queries: DataFrame, k: int, probes: int, id_col: str = "vec_id", vec_col: str = "embedding") -> float:
    """The share of the true k nearest that a search of so many lists finds; 1 where there are none."""
    true = search(index, queries, k, probes, True, id_col, vec_col).select("qid", "id")
    found = search(index, queries, k, probes, False, id_col, vec_col).select("qid", "id", F.lit(1).alias("hit"))
    got = true.join(found, ["qid", "id"], "left").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits")).first()
    return got["hits"] / got["n"] if got["n"] else 1.0


def tune(index: Lists, queries: DataFrame, k: int, target: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> int:
    """The least number of lists, doubled from 1, whose recall over ``queries`` (some hundred are enough) reaches the target."""
    probes = 1
    while probes < len(index.sizes) and recall(index, queries, k, probes, id_col, vec_col) < target:
        probes *= 2
    return min(probes, max(1, len(index.sizes)))
