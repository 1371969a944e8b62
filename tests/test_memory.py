"""What tasks hold in Python stays the same however large their batches and groups are, and equal inputs get equal figures."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from skerry.operators import blocks, knn, lists
from skerry.operators.lexical import Bm25
from skerry.plans.search import DEEP, K


def peak_mb(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def batch(ids, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(x), pa.list_(pa.float64()))], ["id", "v"])


def same_as_sort(got, ids, x, qs, k):
    d = 1 - qs @ x.T / (np.linalg.norm(qs, axis=1)[:, None] * np.linalg.norm(x, axis=1))
    want = [(n, i, v) for n, row in enumerate(d) for v, i in sorted(zip(np.round(row, 12).tolist(), ids, strict=True))[:k]]
    rows = [r for p in got for r in zip(*(c.to_pylist() for c in p.columns), strict=True)]
    return [r[:2] for r in rows] == [r[:2] for r in want] and np.allclose([r[2] for r in rows], [r[2] for r in want], rtol=0, atol=1e-11)


def test_knn_holds_no_matrix_of_a_whole_batch():
    rnd = np.random.default_rng(1)
    qs, x = rnd.normal(size=(600, 16)), rnd.normal(size=(10_000, 16))
    b = batch(list(range(10_000)), x)
    got = []
    assert peak_mb(lambda: got.extend(knn._search(list(range(600)), qs, 5, True)(iter([b])))) < 60
    assert same_as_sort(got, list(range(10_000)), x, qs, 5)


#: By query: what it asks of each of its vectors, and how many rows of a batch are copies of one vector.
SEARCHES = {"ir_metrics_agg": (K + 1, 0), "knn_image_rescaled": (DEEP, 0), "image_dedupe": (DEEP, 3_000), "knn_cosine_topk": (K, 3_000)}


@pytest.mark.parametrize("query", SEARCHES)
def test_a_searching_task_is_as_small_over_more_batches(query):
    k, copies = SEARCHES[query]
    rnd = np.random.default_rng(5)
    qs, x = rnd.normal(size=(knn.BLOCK, 64)), rnd.normal(size=(10_000, 64))
    x[:copies] = qs[: len(qs) * copies // len(x)] = x[0]
    batches = [batch(list(range(n, n + len(x))), x) for n in range(0, 4 * len(x), len(x))]
    got = []
    run = lambda n: peak_mb(lambda: got.append(pa.Table.from_batches(knn._search(list(range(len(qs))), qs, k, True)(iter(batches[:n])))))
    one, four = run(1), run(4)
    assert one < 100 and four < 1.1 * one  # all pairs of a tile tied take 81 MB
    rows = got[1].to_pandas()
    assert len(rows) == k * len(qs)
    for q in (0, 1, len(qs) // 2, len(qs) - 1):
        d = np.tile(1 - (x * qs[q]).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.linalg.norm(qs[q])), 4)
        assert rows[rows["qid"] == q]["id"].tolist() == np.lexsort((np.arange(len(d)), d))[:k].tolist()


def test_knn_in_tiles_loses_nothing():
    rnd = np.random.default_rng(2)
    qs, x = rnd.normal(size=(7, 5)), rnd.normal(size=(90, 5))
    x[40:80] = x[3]  # more copies than k
    ids = [f"v{i:03}" for i in rnd.permutation(90)]
    for tile, pairs in ((1, 1), (4, 3), (33, 1000), (1000, 1000)):
        got = list(knn._search(list(range(7)), qs, 12, False, tile, pairs)(iter([batch(ids[:50], x[:50]), batch(ids[50:], x[50:])])))
        assert same_as_sort(got, ids, x, qs, 12)


def test_equal_vectors_lie_at_equal_distances():
    rnd = np.random.default_rng(3)
    one, qs = rnd.normal(size=64), rnd.normal(size=(50, 64))
    far = {}
    for n in (1, 3, 17, 200):
        x = rnd.normal(size=(n, 64))
        x[n // 2] = one
        for p in knn._search(list(range(50)), qs, n, True)(iter([batch(list(range(n)), x)])):
            for q, i, d in zip(*(c.to_pylist() for c in p.columns), strict=True):
                if i == n // 2:
                    far.setdefault(q, set()).add(d)
    assert all(len(d) == 1 for d in far.values()) and len(far) == 50


def test_a_block_keeps_a_bounded_part_of_its_sums():
    docs, terms = 10_000, 600
    every = np.arange(docs, dtype=np.int32)
    names = [f"t{i:03}" for i in range(terms)]
    held = blocks._Lists(
        np.tile(every, terms), np.ones(docs * terms, np.int32), np.arange(terms) * docs, np.full(terms, docs), {t: (np.array([i]), np.ones(1)) for i, t in enumerate(names)}, dict.fromkeys(names, 2.0)
    )
    block = blocks._Block(every, np.zeros(docs, np.int64), np.ones(docs), held, Bm25())
    want = block.best(names[:2], 3)
    assert peak_mb(lambda: [block.best(names[i : i + 4], 3) for i in range(0, terms, 4)]) < 40
    assert all((a == b).all() for a, b in zip(block.best(names[:2], 3), want, strict=True))


class _Frame:
    """Stands for a DataFrame: gives the function that ``mapInArrow`` takes."""

    def __init__(self, spark, columns, types):
        self.sparkSession, self.columns, self.schema = spark, columns, types

    def select(self, *_):
        return self

    def mapInArrow(self, f, _):
        self.f = f
        return self

    def withColumn(self, *_):
        return self


def test_queries_that_read_every_list_are_written_in_small_batches(spark):
    rnd = np.random.default_rng(4)
    n, wide = 700, 16
    centroids = rnd.normal(size=(n, wide))
    centroids /= np.linalg.norm(centroids, axis=1)[:, None]
    index = lists.Lists(None, centroids, np.ones(n, np.int64), np.full(n, 3.0))
    q = spark.createDataFrame([], "qid long, v array<double>, far double")
    got = _Frame(spark, q.columns, q.schema)
    lists._wanted(index, got, 1, 8)
    x = rnd.normal(size=(3000, wide))
    b = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.array(list(x), pa.list_(pa.float64())), pa.array(np.full(3000, 2.0))], ["qid", "v", "far"])
    seen, most = np.zeros(3000, np.int64), []

    def work():
        for out in got.f(iter([b])):
            most.append(out.num_rows)
            seen.__iadd__(np.bincount(out.column(2).to_numpy(), minlength=3000))

    assert peak_mb(work) < 120
    assert (seen == n - 8).all() and max(most) <= lists.OUT
