import random
import re
import zlib
from collections import Counter

import pytest
from conftest import SF
from helpers import DOCS, ODD, docs, table
from oracle import differences, duck
from pyspark.sql import functions as F

from skerry.llm import variants as V
from skerry.llm.queries_variants import OP12_SQL, op12_variants


def edits(w, letters):
    out = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
    return (out | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}) - {w}


def brute(vocab):
    letters = {c for w in vocab for c in w}
    near = {w: sorted((x for x in edits(w, letters) if x in vocab), key=lambda x: (-vocab[x], x)) for w in vocab}
    form = {w: near[w][0] if near[w] and vocab[near[w][0]] >= 5 * vocab[w] else None for w in vocab}

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, len(near[w]), vocab[form[w]] if form[w] else None) for w, n in vocab.items()}


def counted(rows):
    out = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def rows_of(df):
    got = df.collect()
    assert len({r["word"] for r in got}) == len(got)
    return {tuple(r[c] for c in COLUMNS) for r in got}


def test_equals_sql(spark):
    assert differences(spark, duck(SF), op12_variants, OP12_SQL, SF) == []


def test_neighbourhoods_are_whole_and_distinct(spark):
    words = ["a", "aab", "bbb", "éba", "abab"]
    letters = ["a", "b", "é"]
    got = V.neighbours(spark.createDataFrame([(w,) for w in words], "word string"), letters).collect()
    for w in words:
        mine = [r["candidate"] for r in got if r["word"] == w]
        assert len(mine) == len(set(mine)) and set(mine) == edits(w, letters)


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_variants_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(V, "BROADCAST_BYTES", most)
    rnd = random.Random(12)
    vocab = {"".join(rnd.choice("abé") for _ in range(rnd.randint(1, 7))): rnd.choice([1, 2, 5, 10, 25, 125, 700]) for _ in range(400)}
    chain = {"xxxxxx": 1, "xxxxxxy": 5, "xxxxxxyy": 25, "xxxxxxyyy": 125, "xxxxxxyyyy": 625, "xxxxxxyyyyy": 3125}
    vocab |= chain
    got = rows_of(V.variants(spark.createDataFrame(list(vocab.items()), "word string, n long").repartition(3)))
    assert got == brute(vocab)
    assert {r[2] for r in got if r[0] in chain} == {"xxxxxxyyyyy"}


def test_ties_fall_to_the_smallest_word(spark):
    got = {r["word"]: r for r in V.variants(spark.createDataFrame([("abcdeg", 50), ("abcdef", 50), ("abcdez", 1)], "word string, n long")).collect()}
    assert got["abcdez"]["form"] == "abcdef" and got["abcdef"]["form"] is None and got["abcdef"]["n_near"] == 2


def test_whole_query_against_brute_force(spark, tmp_path):
    rnd = random.Random(3)
    pool = ["Window", "windows", "winds", "géant", "géante", "ÉTUDES", "Études", "maison×s", "maisons", "straße", "strasse", "abcdefg", "abcdefgh"]
    rows = [(i if i % 9 else None, " ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60))) + rnd.choice([".", "\n", "42"]), "en", "s", 1) for i in range(150)]
    sf = table(spark, tmp_path, "documents", rows + ODD, DOCS)
    want = counted(rows + ODD)
    assert len(want) > 8
    assert rows_of(op12_variants(spark, sf)) == brute(want)


def test_odd_rows(spark):
    d = docs(spark).withColumn("a.b", F.lit(1)).withColumn("w", F.lit("w")).withColumn("word", F.lit(1)).withColumn("h", F.create_map(F.lit("k"), F.lit(1)))
    got = {r["word"]: r["n"] for r in V.words(d, "[A-Za-z]+").collect()}
    assert got["x"] == 20_000 and got["plain"] == 3 and "" not in got
    vocab = spark.createDataFrame([("abc", 3, 1), ("", 9, 1), (None, 2, 1)], "word string, n long, form int").withColumn("near_n", F.lit(1)).withColumn("a.b", F.lit(1))
    assert rows_of(V.variants(vocab)) == {("abc", None, "abc", 3, 0, None)}
    assert V.variants(vocab.limit(0)).count() == 0 and V.words(d.limit(0), "[a-z]+", edit=199).count() == 0
