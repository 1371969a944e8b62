import random

import pytest
from pyspark.sql import functions as F

from skerry.operators import fusion, knn, lexical, manifest, metrics, results
from skerry.sources.files import compile_rules, ignored, is_ignored, scan


def test_scores(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.3,), (-0.5,), (1.5,), (0.85,), (0.60,), (0.725,)], "distance double")
    got = df.select(knn.search_score().alias("s"), knn.image_score().alias("i")).collect()
    assert [r["s"] for r in got[:5]] == [1, 0, 0.7, 1, 0]
    assert [r["i"] for r in got] == [1, 0, 1, 1, 0, 0, 1, 0.5]


def test_knn_blocks_and_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)] + [(100, None), (101, [0.0] * 5)]
    c = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    q = c.filter("vec_id < 7")
    a = {(r["qid"], r["rank"]): r["id"] for r in knn.knn(c, q, 4).collect()}
    b = {(r["qid"], r["rank"]): r["id"] for r in knn.knn(c, q, 4, block=2).collect()}
    assert a == b and all(a[i, 1] == i for i in range(7)) and len(a) == 28
    assert knn.knn(c, c.limit(0), 3).count() == 0


def ranked(spark, ids):
    return spark.createDataFrame([(0, x, i + 1) for i, x in enumerate(ids)], "qid long, id string, rank int")


def test_rrf(spark):
    got = fusion.rrf(ranked(spark, ["a", "b"]), ranked(spark, ["b", "a"])).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [("a", 1.0), ("b", 1.0)]
    got = fusion.rrf(ranked(spark, ["a"]), ranked(spark, ["a", "c"])).orderBy("rank").collect()
    assert got[0]["id"] == "a" and got[0]["score"] == 1.0 and got[1]["score"] < 1
    assert fusion.rrf(ranked(spark, []), ranked(spark, [])).count() == 0
    s, x = ranked(spark, ["a", "b"]).withColumn("src", F.lit("sem")), ranked(spark, ["b"]).withColumn("src", F.lit("lex"))
    assert {r["id"]: r["src"] for r in fusion.rrf(s, x, carry=("src",)).collect()} == {"a": "sem", "b": "lex"}


CHUNK = "qid int, file_path string, chunk_index int, line_start int, line_end int, chunk_text string, score double"


def test_collapse(spark):
    rows = [(0, "f", 0, 5, 10, "a", 0.7), (0, "f", 1, 11, 20, "b", 0.9), (0, "f", 2, 21, 30, "c", 0.8), (0, "g", 0, 1, 2, "x", 0.5), (0, "g", 5, 3, 4, "y", 0.5)]
    got = results.filter_and_collapse(spark.createDataFrame(rows, CHUNK), 10).orderBy("rank").collect()
    assert (got[0]["line_start"], got[0]["line_end"], got[0]["score"], got[0]["chunk_text"]) == (5, 30, 0.9, "a\nb\nc")
    assert len(got) == 3
    again = [(0, "f", i, 0, 0, None, 0.1) for i in (0, 0, 2)]
    assert sorted(r["run_start"] for r in results.collapse(spark.createDataFrame(again, CHUNK)).collect()) == [0, 0, 2]


def test_post_filter(spark):
    df = spark.createDataFrame([("src/a", 0.4, "m"), ("src2/b", 0.6, "n")], "file_path string, score double, model_id string")
    assert results.post_filter(df, dir="./src/").count() == 2
    assert results.post_filter(df, dir="src", strict_dir=True).count() == 1
    assert results.post_filter(df, threshold=0.5, model=lambda m: m == "n").count() == 1


def test_bm25_edges(spark):
    docs = spark.createDataFrame([(1, "getUserName returns user"), (2, "nothing here"), (3, None)], "doc_id long, text string")
    post = lexical.postings(docs)
    q = lexical.query_terms(spark.createDataFrame([(0, "us"), (1, ""), (2, "zzz")], "qid long, query string"))
    got = lexical.bm25(post, lexical.expand_prefixes(post.select("term").distinct(), q)).collect()
    assert [(r["qid"], r["doc_id"]) for r in got] == [(0, 1)]


def test_manifest(spark):
    s = "path string, mtime long, size long, hash string"
    old = spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 1, "x"), ("c", 1, 1, "x"), ("d", 1, 1, "x")], s)
    new = spark.createDataFrame([("a", 1, 1, "x"), ("b", 2, 1, "x"), ("c", 2, 1, "y"), ("e", 1, 1, "z")], s)
    assert {r["path"]: r["status"] for r in manifest.diff_files(new, old).collect()} == {"a": "unchanged", "b": "touched", "c": "changed", "d": "deleted", "e": "new"}
    assert manifest.staleness(new, old).first()["n_stale"] == 4
    assert manifest.staleness(new.limit(0), old.limit(0)).first()["n_stale"] == 0


def test_metrics(spark):
    rel = spark.createDataFrame([(0, "a"), (0, "b"), (1, "z")], "qid long, id string")
    got = {r["qid"]: r for r in metrics.ir_metrics(ranked(spark, ["x", "a", "y", "b"]), rel).collect()}
    assert got[0]["rr"] == 0.5 and got[0]["recall"] == 0.5 and got[0]["p1"] == 0 and got[1]["rr"] == 0
    assert metrics.mean_metrics(metrics.ir_metrics(ranked(spark, []), rel.limit(0))).first()["n"] == 0
    x = spark.createDataFrame([("a", float(i)) for i in range(10)], "k string, v double")
    r = metrics.latency_summary(x, "k", "v").first()
    assert (r["p50"], r["p95"], r["p99"], r["mean"]) == (5, 9, 9, 4.5)


RULES = ["node_modules", "*.lock", "/top.txt", "docs/", "!keep.lock", "a/**/z.py", "x?.c", "# comment", "", "[ab].h"]


@pytest.mark.parametrize(
    "path, want",
    [
        ("node_modules/a.js", True), ("src/node_modules/b/c.js", True), ("y.lock", True), ("keep.lock", False), ("q/keep.lock", False), ("top.txt", True), ("s/top.txt", False), ("docs/a.md", True),
        ("docs", False), ("a/z.py", True), ("a/b/c/z.py", True), ("x1.c", True), ("x12.c", False), ("b.h", True), ("c.h", False), ("src/a.ts", False),
    ],
)
def test_ignore_rules(spark, path, want):
    rules = compile_rules(RULES)
    assert is_ignored(path, rules) is want
    assert spark.createDataFrame([(path,)], "p string").select(ignored(F.col("p"), rules).alias("x")).first()["x"] is want


def test_scan(spark, tmp_path):
    for name in ("a.ts", "__init__.py", ".eslintrc.json", "b.unknown", "img.PNG", "lib/c.md", "node_modules/d.js", "skip/e.ts"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("x")
    (tmp_path / ".gitignore").write_text("skip/\n")
    (tmp_path / "link.ts").symlink_to(tmp_path / "a.ts")
    got = {r["path"]: r["type"] for r in scan(spark, str(tmp_path)).collect()}
    assert got == {"a.ts": "code", "__init__.py": "code", ".eslintrc.json": "code", "img.PNG": "image", "lib/c.md": "text"}
    assert "skip/e.ts" in {r["path"] for r in scan(spark, str(tmp_path), use_ignore_files=False).collect()}
    assert [r["path"] for r in scan(spark, str(tmp_path), type_filter="text").collect()] == ["lib/c.md"]


def test_scan_on_executors_equals_a_walk(spark, tmp_path):
    import os

    rnd = random.Random(1)
    names = ["a.ts", "b.md", "c.png", "d.xyz", ".hidden.py", "skip.log.txt", "e.min.js"]
    (tmp_path / ".gitignore").write_text("skip*\n/f1/f2/\nf3/*\n!f3/keep\n")
    folders = [""]
    for _ in range(300):
        rel = os.path.join(rnd.choice(folders), rnd.choice(["f1", "f2", "f3", "keep", "node_modules", ".dot"]))
        os.makedirs(tmp_path / rel, exist_ok=True)
        folders.append(rel)
        (tmp_path / rel / rnd.choice(names)).write_text("x" * rnd.randint(0, 9))
    (tmp_path / "f1").mkdir(exist_ok=True)
    (tmp_path / "f1/link.ts").symlink_to(tmp_path / ".gitignore")

    from skerry.sources.files import EXCLUDED, EXTENSIONS

    rules = compile_rules([*EXCLUDED, *(tmp_path / ".gitignore").read_text().splitlines()])
    want = set()
    for d, _, files in os.walk(tmp_path):
        for f in files:
            rel, full = os.path.relpath(os.path.join(d, f), tmp_path), os.path.join(d, f)
            kind = EXTENSIONS.get(os.path.splitext(f)[1].lower())
            if kind and not os.path.islink(full) and not is_ignored(rel, rules):
                want.add((rel, kind, os.path.getsize(full)))
    assert len(want) > 10
    for tasks in (1, 4, 1000):
        got = scan(spark, str(tmp_path), tasks=tasks)
        rows = [(r["path"], r["type"], r["size"]) for r in got.collect()]
        assert set(rows) == want and len(rows) == len(want)
    assert {r["path"] for r in scan(spark, str(tmp_path), type_filter="text").collect()} == {p for p, k, _ in want if k == "text"}


def test_knn_ids_of_any_type(spark):
    rng = random.Random(4)
    rows = [(i, f"n{i:02}", [rng.gauss(0, 1) for _ in range(5)]) for i in range(40)]
    c = spark.createDataFrame(rows, "num long, name string, embedding array<float>").repartition(3)
    by_num = {(r["qid"], r["rank"]): r["id"] for r in knn.knn(c, c.filter("num < 5"), 4, id_col="num").collect()}
    by_name = {(r["qid"], r["rank"]): r["id"] for r in knn.knn(c, c.filter("num < 5"), 4, id_col="name").collect()}
    assert {(f"n{q:02}", k): f"n{i:02}" for (q, k), i in by_num.items()} == by_name
    mixed = knn.knn(c, c.filter("num < 5"), 4, id_col="name", query_id_col="num")
    assert {(r["qid"], r["rank"]): r["id"] for r in mixed.collect()} == {(q, k): f"n{i:02}" for (q, k), i in by_num.items()}
    assert knn.knn(c, c.limit(0), 4, id_col="name").count() == 0


def test_latency_of_one_hot_group(spark):
    rng = random.Random(9)
    rows = [("hot", float(rng.randint(0, 500))) for _ in range(3000)] + [("flat", 7.0)] * 40 + [("one", 3.5), (None, 1.0), (None, 9.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: r for r in metrics.latency_summary(df, "k", "v").collect()}
    assert set(got) == {"hot", "flat", "one", None}
    for k, r in got.items():
        v = sorted(x for g, x in rows if g == k and x is not None)
        assert (r["n"], r["least"], r["most"]) == (len(v), v[0], v[-1]) and abs(r["mean"] - sum(v) / len(v)) < 1e-9
        assert [r["p50"], r["p95"], r["p99"]] == [v[int(len(v) * p)] for p in (0.5, 0.95, 0.99)]
    assert metrics.latency_summary(df.limit(0), "k", "v").count() == 0


def test_metrics_by_label_equal_those_by_pairs(spark):
    rng = random.Random(6)
    labels = {i: rng.choice([1, 1, 1, 2, 3]) for i in range(60)} | {60: 9, 61: None}
    items = spark.createDataFrame(list(labels.items()), "id long, label int")
    ask = {i: labels[i] for i in list(range(10)) + [60, 61]} | {100: 2}  # 100 is no item
    queries = spark.createDataFrame(list(ask.items()), "qid long, label int")
    ranked = spark.createDataFrame([(q, i, n + 1) for q in ask for n, i in enumerate(rng.sample(range(62), 8))], "qid long, id long, rank int")
    pairs = spark.createDataFrame([(q, i) for q, k in ask.items() for i, x in labels.items() if k is not None and x == k and i != q], "qid long, id long")
    tuples = lambda df: sorted(tuple(r) for r in df.collect())
    want = tuples(metrics.ir_metrics(ranked.filter("id <> qid"), pairs))
    assert tuples(metrics.ir_metrics_by_label(ranked, items, queries)) == want and len(want) == 11
