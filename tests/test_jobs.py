import glob
import os
import subprocess
import sys

import pytest
from conftest import SF
from oracle import differences, duck
from pyspark.sql import functions as F

from jobs import answer_queries as A2
from jobs import refresh_passages as R
from jobs.common import read_config
from jobs.registry import JOBS, JOBS_SQL
from skerry.functions import text as T

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("name", sorted(JOBS))
def test_equals_sql(spark, name):
    assert differences(spark, duck(SF), JOBS[name], JOBS_SQL[name], SF) == []


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def parts(folder):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{folder}/**/*.parquet", recursive=True)}


def add(spark, folder, name, got, at):
    """One more file of documents, as old as told."""
    tmp = f"{folder}.new/{name}"
    spark.createDataFrame(got, "doc_id long, text string, source string, extra int").coalesce(1).write.parquet(tmp)
    os.makedirs(folder, exist_ok=True)
    (file,) = glob.glob(f"{tmp}/*.parquet")
    os.rename(file, f"{folder}/{name}.parquet")
    os.utime(f"{folder}/{name}.parquet", (at, at))


A, B, C = "alpha beta\ngammaDelta " * 40, "other words here. " * 120, "short"


def expected(spark, docs):
    """The passages of the latest texts, cut by the library alone."""
    d = spark.createDataFrame(docs, "doc_id long, source string, text string")
    got = d.select("doc_id", "source", F.posexplode(T.paragraph_chunks(F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "\n\n"))).alias("chunk_index", "passage"))
    return sorted((r["doc_id"], r["source"], r["chunk_index"], r["passage"]) for r in got.collect())


def latest(spark, out):
    return sorted((r["doc_id"], r["source"], r["chunk_index"], r["passage"]) for r in R.current(spark, out).collect())


def test_growing_input(spark, tmp_path):
    docs, out, mark = f"{tmp_path}/docs", f"{tmp_path}/out", f"{tmp_path}/mark"
    add(spark, docs, "one", [(1, A, "s", 0), (2, B, "s", 0), (3, None, "t", 0), (None, A, "s", 0), (4, "", "t", 0), (5, C, "t", 0), (5, C, "t", 1)], 1000)
    (first,) = R.run(spark, docs, out, mark)
    assert (first["rows_read"], first["rows_without_id"], first["documents"], first["passages_written"]) == (7, 1, 5, len(latest(spark, out)))
    assert latest(spark, out) == expected(spark, [(1, "s", A), (2, "s", B), (5, "t", C)])
    before = parts(out)
    assert R.run(spark, docs, out, mark) == [] and parts(out) == before

    # 1 is changed, 2 comes again unchanged in another folder, 6 is new
    add(spark, docs, "two", [(1, B, "s", 0), (2, B, "u", 0), (6, A, "u", 0)], 2000)
    (second,) = R.run(spark, docs, out, mark)
    assert second["rows_read"] == 3 and second["documents"] == 3
    assert {f: t for f, t in parts(out).items() if f in before} == before
    assert latest(spark, out) == expected(spark, [(1, "s", B), (2, "u", B), (5, "t", C), (6, "u", A)])

    # an older file comes late, and 1 goes back to its first text, which isn't cut again
    add(spark, docs, "late", [(1, C, "s", 0), (6, C, "u", 0)], 1500)
    R.run(spark, docs, out, mark)
    assert latest(spark, out) == expected(spark, [(1, "s", B), (2, "u", B), (5, "t", C), (6, "u", A)])
    add(spark, docs, "back", [(1, A, "s", 0)], 3000)
    (back,) = R.run(spark, docs, out, mark)
    assert back["passages_written"] == 0 and latest(spark, out) == expected(spark, [(1, "s", A), (2, "u", B), (5, "t", C), (6, "u", A)])

    # all files at once, in batches of one, without the checkpoint: the same rows
    R.run(spark, docs, f"{tmp_path}/again", f"{tmp_path}/mark2", {"files_a_batch": 1})
    assert latest(spark, f"{tmp_path}/again") == latest(spark, out)


def test_a_batch_that_failed_half_way_is_replaced(spark, tmp_path, monkeypatch):
    docs, out, mark = f"{tmp_path}/docs", f"{tmp_path}/out", f"{tmp_path}/mark"
    add(spark, docs, "one", [(1, A, "s", 0), (2, B, "t", 0)], 1000)
    write = R._write

    def fails(df, number, path, by):
        got = write(df, number, path, by)
        if path.endswith("passages"):
            raise RuntimeError("lost")
        return got

    monkeypatch.setattr(R, "_write", fails)
    with pytest.raises(Exception, match="lost"):
        R.run(spark, docs, out, mark)
    assert latest(spark, out) == [] and parts(f"{out}/passages")
    monkeypatch.setattr(R, "_write", write)
    (got,) = R.run(spark, docs, out, mark)
    assert got["batch"] == 0 and latest(spark, out) == expected(spark, [(1, "s", A), (2, "t", B)])


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/docs")
    R.run(spark, f"{tmp_path}/docs", f"{tmp_path}/out", f"{tmp_path}/mark")
    assert R.current(spark, f"{tmp_path}/out").count() == 0


def test_config(spark, tmp_path):
    assert read_config(spark, f"{HERE}/jobs/refresh_passages.json", R.DEFAULTS) == R.DEFAULTS
    (tmp_path / "bad.json").write_text('{"most": 3}')
    with pytest.raises(ValueError, match="unknown settings most"):
        read_config(spark, f"{tmp_path}/bad.json", R.DEFAULTS)


def test_command_line(tmp_path):
    args = ["--input", f"{SF}/documents.parquet", "--output", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/mark", "--config", f"{HERE}/jobs/refresh_passages.json"]
    for batches in (1, 0):
        got = subprocess.run([sys.executable, f"{HERE}/jobs/refresh_passages.py", *args], capture_output=True, text=True, timeout=300)
        assert got.returncode == 0 and f"{batches} batches" in got.stderr and ("rows_read=200" in got.stderr) == bool(batches)


def test_answers(spark, tmp_path):
    docs = [(1, "graph node search", "s"), (2, "graph graph nodes", "t"), (3, "graph node search", "t"), (4, None, "t"), (5, "", "u"), (6, "search", "")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(2).write.parquet(f"{tmp_path}/docs")
    items = [(1, "node search"), (2, "nothing here"), (3, None), (4, "nod graph"), (4, "graph search")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/items")
    out = f"{tmp_path}/out"
    first = A2.run(spark, f"{tmp_path}/items", f"{tmp_path}/docs", out, {"k": 2})
    assert (first["documents_read"], first["queries_read"], first["answers_written"]) == (6, 5, 4)
    got = rows(A2.read_answers(spark, out).select("qid", "rank", "doc_id", "matched", F.coalesce("source", F.lit("-"))))
    assert got == [(1, 1, 1, 2, "s"), (1, 2, 3, 2, "t"), (4, 1, 1, 3, "s"), (4, 2, 3, 3, "t")]
    assert rows(spark.read.parquet(f"{out}/sources").select("source", "hits", "queries", "firsts")) == [("s", 2, 2, 2), ("t", 2, 2, 0)]
    whole = rows(A2.read_answers(spark, out).select("qid", "doc_id", "rank", "score", "matched", "source"))
    assert A2.run(spark, f"{tmp_path}/items", f"{tmp_path}/docs", out, {"k": 2}) == first
    assert rows(A2.read_answers(spark, out).select("qid", "doc_id", "rank", "score", "matched", "source")) == whole
    # a source that no longer answers leaves no partition behind
    A2.run(spark, f"{tmp_path}/items", f"{tmp_path}/docs", out, {"k": 1, "prefixes": False})
    assert sorted(os.path.basename(p) for p in glob.glob(f"{out}/answers/source=*")) == ["source=s"]


def test_answers_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/items")
    assert A2.run(spark, f"{tmp_path}/items", f"{tmp_path}/docs", f"{tmp_path}/out")["answers_written"] == 0
    assert A2.read_answers(spark, f"{tmp_path}/out").count() == 0


def test_answers_command_line(tmp_path):
    args = ["--queries", f"{SF}/benchmark.parquet", "--documents", f"{SF}/documents.parquet", "--output", f"{tmp_path}/out", "--config", f"{HERE}/jobs/answer_queries.json"]
    got = subprocess.run([sys.executable, f"{HERE}/jobs/answer_queries.py", *args], capture_output=True, text=True, timeout=300, cwd=tmp_path)
    assert got.returncode == 0 and "documents_read=200 queries_read=40" in got.stderr


def test_nothing_of_a_session_is_changed_and_settings_are_known(spark, tmp_path):
    assert read_config(spark, f"{HERE}/jobs/answer_queries.json", A2.DEFAULTS) == A2.DEFAULTS
    before = spark.conf.getAll
    A2.job2_answer_queries(spark, SF)
    R.job1_refresh_passages(spark, SF)
    assert spark.conf.getAll == before
