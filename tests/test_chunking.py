import random
import re
import time

from pyspark.sql import functions as F

from skerry.operators import chunking


def brute(text, spans, window=500, overlap=50):
    """(index, first line, last line, tokens, text), window by window."""
    n = len(spans)
    if n <= window:
        return [(0, 1, text.count("\n") + 1, n, text)]
    out, start = [], 0
    while True:
        end = min(start + window, n)
        at, to = (spans[start - 1][1] if start else 0), spans[end - 1][1]
        out.append((len(out), text.count("\n", 0, spans[start][0]) + 1, text.count("\n", 0, to) + 1, end - start, text[at:to]))
        if end == n:
            return out
        start = end - overlap if end < n else n


def rows(df):
    return sorted((r["path"], r["chunk_index"], r["line_start"], r["line_end"], r["token_count"], r["chunk_text"]) for r in df.collect())


def test_windows_against_brute_force(spark):
    rnd = random.Random(7)
    pool = ["foo", "bar_1", "(", ")", "=", "é", "\U0001f600", " ", "\n", "\t", "\n\n"]
    texts = ["", "\n", "one", *["".join(rnd.choice(pool) for _ in range(n)) for n in (30, 900, 1100, 3000, 5000)], "x " * 500, "x " * 501, "x\n" * 950, "x\n" * 951]
    df = spark.createDataFrame([(f"f{i}", "code", t) for i, t in enumerate(texts)] + [("null", "code", None)], "path string, type string, text string")
    spans = lambda p, t: [m.span() for m in re.finditer(p, t, re.ASCII)]
    assert rows(chunking.code_chunks(df)) == sorted((f"f{i}", *w) for i, t in enumerate(texts) for w in brute(t, spans(chunking.TOKEN, t)))
    # a tokenizer of the caller's, as the tokens of a model
    assert rows(chunking.code_chunks(df, lambda t: [m.span() for m in re.finditer(r"\S+", t, re.ASCII)])) == sorted((f"f{i}", *w) for i, t in enumerate(texts) for w in brute(t, spans(r"\S+", t)))


def test_a_tokenizer_goes_through_an_index(spark, tmp_path):
    from skerry import api

    (tmp_path / "a.py").write_text("a" * 600 + "\nb")
    api.index(spark, str(tmp_path), tokenizer=lambda t: [(i, i + 1) for i in range(len(t))])
    got = api._store(spark, str(tmp_path)).load("chunks").orderBy("chunk_index").collect()
    assert [(r["token_count"], r["line_start"], r["line_end"]) for r in got] == [(500, 1, 1), (152, 1, 2)]


def test_ten_megabytes_in_seconds(spark):
    line = "value = compute(first, second)\n"
    df = spark.createDataFrame([("big.py", "code")], "path string, type string").withColumn("text", F.repeat(F.lit(line), 10_000_000 // len(line)))
    began = time.time()
    got = chunking.code_chunks(df).agg(F.count(F.lit(1)), F.max("line_end"), F.sum(F.length("chunk_text"))).first()
    assert time.time() - began < 30 and got[0] > 5000 and got[1] == 10_000_000 // len(line)
