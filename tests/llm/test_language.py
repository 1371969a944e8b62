import zlib

import numpy as np
from conftest import SF
from helpers import ODD, docs, table
from pyspark.sql import functions as F

from skerry.llm import language as L
from skerry.llm.common import read_table
from skerry.llm.queries_language import op11_language


def vector(t):
    """The definition, letter by letter."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in t or ""]
    s = [0, *[ord(c) if c.isalpha() else 0 for c in low], 0]
    out = np.zeros(L.DIMS, np.int64)
    for a, b, c in zip(s, s[1:], s[2:], strict=False):
        if b:
            out += np.roll(L._letter(a), 2).astype(np.int64) * np.roll(L._letter(b), 1) * L._letter(c)
    return out


def test_a_text_is_the_sum_of_its_trigrams(monkeypatch):
    texts = ["Hello, wörld", None, "", " 12 \n", "a", "İstanbul ΣΊΣΥΦΟΣ 漢字 \U0001f600x", "no  end-of  words"]
    want = np.array([vector(t) for t in texts])
    for chars, grams in ((1 << 20, 8192), (3, 2), (1, 1)):
        monkeypatch.setattr(L, "STEP_CHARS", chars)
        monkeypatch.setattr(L, "STEP_GRAMS", grams)
        got, count = L.bundles(texts, np.arange(len(texts)), len(texts))
        assert (got == want).all() and list(count) == [sum(c.isalpha() for c in t or "") for t in texts]
    together, _ = L.bundles(texts, np.array([0, 1, 0, 1, 0, 1, 0]), 2)
    assert (together == np.array([want[::2].sum(0), want[1::2].sum(0)])).all()


def test_query_against_brute_force_and_held_out_accuracy(spark):
    d = read_table(spark, SF, "documents").collect()
    out = {r["doc_id"]: r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in d}
    protos: dict = {}
    vectors = {r["doc_id"]: vector(r["text"]) for r in d}
    for r in d:
        if not out[r["doc_id"]] and r["lang"] is not None:
            protos[r["lang"]] = protos.get(r["lang"], 0) + vectors[r["doc_id"]]
    rows = op11_language(spark, SF).collect()
    assert len(rows) == len(d)
    right = []
    for r in rows:
        v = vectors[r["doc_id"]]
        cos = {k: round(float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)), 9) for k, p in protos.items()}
        best = min(cos, key=lambda k: (-cos[k], k))
        assert r["lang_pred"] == best and abs(r["score"] - cos[best]) < 1e-8 and r["held_out"] == out[r["doc_id"]]
        right += [r["lang_pred"] == next(x["lang"] for x in d if x["doc_id"] == r["doc_id"])] if r["held_out"] else []
    assert np.mean(right) >= 0.97


def test_nothing_but_texts_is_read_for_a_prediction(spark):
    d = read_table(spark, SF, "documents").limit(60)
    model = L.fit(d)
    a = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.predict(d, model).collect()}
    other = d.withColumns({"lang": F.lit("zz"), "source": F.lit(None).cast("string"), "doc_id": -F.col("doc_id")})
    assert {-r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.predict(other, model).collect()} == a


def test_odd_rows(spark):
    d = docs(spark).withColumn("a.b", F.lit(1)).withColumn("m", F.create_map(F.lit("k"), F.lit(1))).withColumn("t", F.lit(1)).withColumn("l", F.lit(1)).withColumn("lang_pred", F.lit("x"))
    model = L.fit(d)
    assert model.languages == ["de", "en", "fr"]
    got = L.predict(d, model)
    assert got.columns == ["doc_id", "lang_pred", "score"]
    rows = got.collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert all((by[k]["lang_pred"], by[k]["score"]) == ("und", 0.0) for k in (2, 3, 4))
    assert all(0 <= r["score"] <= 1 for r in rows) and len({(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] == 6}) == 1
    none = L.fit(d.limit(0))
    assert none.languages == [] and {r["lang_pred"] for r in L.predict(d, none).collect()} == {"und"}
    assert L.predict(d.limit(0), model).count() == 0


def test_ties_fall_to_the_smaller_name(spark):
    d = spark.createDataFrame([(1, "abc abc", "b"), (2, "abc abc", "a")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in L.predict(d, L.fit(d)).collect()} == {"a"}


def test_an_empty_table(spark, tmp_path):
    sf = table(spark, tmp_path, "documents", [], "doc_id long, text string, lang string, source string, n_chars long")
    assert op11_language(spark, sf).count() == 0
