import zlib

import numpy as np
from conftest import SF
from helpers import DOCS, ODD, docs, table

from skerry.llm.common import read_table
from skerry.llm.quality import BUCKETS, DIM, _temperature, chunks, contexts, fit, index_vectors, keep_good, parts_of, pooled, score, train
from skerry.llm.queries_quality import op4_quality

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = op4_quality(spark, sf).collect()
    known = {r["doc_id"]: r["quality"] for r in read_table(spark, sf, "labels").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [(known[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in known]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.95
    # calibration: the mean score of each of ten bins is near its share of label 1
    scores, truth = (np.array([f(r) for r in rows if r["held_out"] and r["doc_id"] in known]) for f in (lambda r: r["score"], lambda r: known[r["doc_id"]]))
    bins = np.minimum((scores * 10).astype(int), 9)
    error = sum(abs(scores[bins == b].mean() - truth[bins == b].mean()) * np.mean(bins == b) for b in set(bins.tolist()))
    assert error < 0.05


def test_temperature_calibrates():
    """Logits that are three times too sure get a divisor near three, and the error of ten bins falls."""
    rng = np.random.default_rng(4)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(float)

    def error(t):
        p = 1 / (1 + np.exp(-3 * z / t))
        b = np.minimum((p * 10).astype(int), 9)
        return sum(abs(p[b == k].mean() - y[b == k].mean()) * np.mean(b == k) for k in set(b.tolist()))

    t = _temperature(3 * z, y)
    assert 2.5 < t < 3.6 and error(t) < 0.03 < error(1.0)


def test_whole_texts_are_read():
    """Each word of a run without spaces counts, and marks of any length."""
    ctx = contexts(["a b"])
    pairs = [("alpha/other/words/that/go/on", "alpha/other/w"), ("x" + "!" * 20, "x" + "!" * 9), ("漢字漢字文", "漢字漢字"), ("a,b,c," * 50 + "d", "a,b,c," * 50 + "e")]
    for a, b in pairs:
        x = pooled([a, b], ctx)
        assert not np.allclose(x[0], x[1])
    assert len(parts_of("one,two/three_four")) == 4 and len(parts_of("漢字")) == 2
    long = "/".join(f"w{i}" for i in range(5000))
    assert np.allclose(pooled([long], ctx)[0], brute_pool(long, ctx), atol=1e-4)


def test_labels_of_the_held_out_fold_are_not_read(spark, tmp_path):
    rows = [tuple(r) for r in read_table(spark, SF, "documents").collect()]
    labels = [tuple(r) for r in read_table(spark, SF, "labels").collect()]
    a = {r["doc_id"]: r["score"] for r in op4_quality(spark, SF).collect()}
    sf = table(spark, tmp_path, "documents", rows, DOCS)
    table(spark, tmp_path, "labels", [(d, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q, t) for d, q, t in labels], LABELS)
    b = {r["doc_id"]: r["score"] for r in op4_quality(spark, sf).collect()}
    assert all(abs(a[d] - b[d]) < 1e-9 for d in a)


def brute_pool(text, context):
    runs = text.split()
    words = [p for w in runs for p in parts_of(w)]
    total, index = np.zeros(2 * DIM), index_vectors()
    for p in words:
        for b in p:
            if b >= 0:
                total += np.concatenate((index[b], context[b]))
    for i, w in enumerate(runs):
        if i and runs[i - 1] == w:
            b = zlib.crc32(b"\1again") % BUCKETS
            total += 4 * np.concatenate((index[b], context[b]))
    return np.concatenate((total / len(words), [np.log1p(len(words))])) if words else np.zeros(2 * DIM + 1)


def test_pooling_equals_brute_force():
    texts = ["", "one", "the The the the end.", " \n", "*** A!! B!! word word\nword", "x" * 1000 + " é"]
    ctx = contexts(texts)
    got = pooled(texts, ctx)
    for t, g in zip(texts, got, strict=True):
        assert np.allclose(g, brute_pool(t, ctx), atol=1e-4)
    assert chunks(["a b", "", "b"])[3].tolist() == [2, 0, 1]


def test_contexts_are_sums_over_neighbours():
    got, index = contexts(["aa bb cc dd", "ee"]), index_vectors()
    b = {w: parts_of(w)[0][0] for w in ("aa", "bb", "cc", "dd", "ee")}
    assert np.allclose(got[b["aa"]], index[b["bb"]] + index[b["cc"]]) and np.allclose(got[b["cc"]], index[b["aa"]] + index[b["bb"]] + index[b["dd"]]) and not got[b["ee"]].any()


def test_odd_rows_and_no_labels(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, None, 0), (None, 1, 0), (7, 3, 0)], LABELS)
    for lab in (labels, labels.limit(0)):
        model = fit(docs(spark), lab)
        rows = score(docs(spark), model).collect()
        assert len(rows) == len(ODD) and all(0 < r["score"] < 1 for r in rows)
    d = docs(spark)
    assert keep_good(d, model, 0.0).count() == len(ODD) and keep_good(d, model, 0.0).schema == d.schema and keep_good(d, model, 1.1).count() == 0
    assert score(d.limit(0), model).count() == 0


def test_training_separates_and_repeats():
    rng = np.random.default_rng(1)
    y = (rng.random(600) < 0.8).astype(float)
    x = rng.normal(0, 1, (600, 2 * DIM + 1)) + y[:, None]
    x[:, -1] = 5
    a, b = train(x, y, np.zeros((1, 1))), train(x, y, np.zeros((1, 1)))
    assert np.mean((a.logits(x) > 0) == y) > 0.95 and np.array_equal(a.logits(x), b.logits(x)) and a.temperature > 0


def test_scores_by_the_definition(spark):
    """The whole query's scores: pooled word by word, through the network row by row."""
    d = read_table(spark, SF, "documents")
    m = fit(d, read_table(spark, SF, "labels"))
    got = {r["doc_id"]: r["score"] for r in op4_quality(spark, SF).collect()}
    for r in d.collect()[:80]:
        x = brute_pool(r["text"], m.context).astype(np.float64)
        n = np.expm1(x[-1])
        drawn = [(v - a) / s * (n / (n + 4) if i < len(x) - 1 else 1) for i, (v, a, s) in enumerate(zip(x, m.mean, m.scale, strict=True))]
        drawn = [min(8.0, max(-8.0, v)) for v in drawn]
        hidden = [max(0.0, sum(v * w for v, w in zip(drawn, m.w1[:, j], strict=True)) + m.b1[j]) for j in range(len(m.b1))]
        z = (sum(h * w for h, w in zip(hidden, m.w2, strict=True)) + m.b2) / m.temperature
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-z))) < 2e-3
