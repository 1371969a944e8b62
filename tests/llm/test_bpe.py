import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest import SF
from helpers import DOCS, ODD, docs, multiset, table

from skerry.llm import tokenfile
from skerry.llm.bpe import encode_decode
from skerry.llm.common import new_dir, read_table, spread
from skerry.llm.queries_bpe import op6_tokenfile, op10_bpe, tokenizer_path
from skerry.llm.words import LIMIT, word_bpe


@pytest.fixture(scope="module")
def bpe():
    return word_bpe(tokenizer_path())


def ids_of(bpe, texts):
    words, codes, head, count = bpe.split(texts)
    ids, lens = bpe.encode(words.to_pylist())
    start = np.cumsum(lens) - lens
    return [ids[spread(start[codes[a : a + n]], lens[codes[a : a + n]])].tolist() for a, n in zip(head, count, strict=True)]


def library(bpe, texts):
    return [e.ids for e in bpe.whole.encode_batch(texts, add_special_tokens=False)]


def test_random_texts_equal_the_library(bpe):
    rnd = random.Random(9)
    pool = "aA'sStTrReEvVlLmMdD ''  <|endoftext|>\n09ÀéσΣİ²½’“”ﬁ́ẛ漢字\U0001f600\x1c\x85\xa0\x00_-.,!?٣ǅ ﻿" + "<|startoftext|>"
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 30))) + ("<|endoftext|>x" if i % 9 == 0 else "") for i in range(1500)]
    assert ids_of(bpe, texts) == library(bpe, texts)


def test_every_character_equals_the_library(bpe):
    texts = [f"a{chr(i)}b{chr(i)}{chr(i)}" for i in range(LIMIT)]
    assert ids_of(bpe, texts) == library(bpe, texts)


def test_odd_rows(spark, bpe):
    got = multiset((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in encode_decode(docs(spark), tokenizer_path()).collect())
    ids = library(bpe, [t or "" for _, t, *_ in ODD])
    assert got == multiset((d, tuple(i), bpe.whole.decode(i, skip_special_tokens=False)) for (d, *_), i in zip(ODD, ids, strict=True))
    assert encode_decode(docs(spark).limit(0), tokenizer_path()).count() == 0


def test_op10_equals_the_library(spark, bpe):
    got = {r["doc_id"]: r for r in op10_bpe(spark, SF).collect()}
    for d, t in read_table(spark, SF, "documents").select("doc_id", "text").collect():
        ids = bpe.whole.encode(t, add_special_tokens=False).ids
        sha = hashlib.sha256(bpe.whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha)


def test_op6_equals_the_library(spark, bpe):
    got, at = {r["doc_id"]: r for r in op6_tokenfile(spark, SF).collect()}, 0
    for d, t in read_table(spark, SF, "documents").select("doc_id", "text").orderBy("doc_id").collect():
        ids = np.array([*bpe.whole.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files_odd_rows_and_single_documents(spark, bpe):
    folder = new_dir(spark, "test")
    tokenfile.write_tokens(docs(spark), folder, tokenizer_path(), 2)
    rows = tokenfile.read_tokens(spark, folder).orderBy("start").collect()
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [(r["doc_id"], r["ids"]) for r in rows] == [(d, [*i, 2]) for (d, *_), i in zip(order, library(bpe, [t or "" for _, t, *_ in order]), strict=True)]
    one = tokenfile.read_documents(folder, {5})
    assert one[5].tolist() == next(r["ids"] for r in rows if r["doc_id"] == 5)
    folder = new_dir(spark, "test")
    tokenfile.write_tokens(docs(spark).limit(0), folder, tokenizer_path(), 2)
    assert tokenfile.read_tokens(spark, folder).count() == 0


def test_damaged_frame_is_noticed(spark, tmp_path):
    import pyarrow as pa

    f = tmp_path / "x"
    with open(f, "wb") as out:
        w = tokenfile.SeekableWriter(out)
        w.frame(b"a" * 1000)
        w.frame(bytes(range(250)) * 4)
        w.close(b"index")
    raw = bytearray(f.read_bytes())
    r = tokenfile.SeekableReader(pa.BufferReader(bytes(raw)))
    assert r.frame(1) == bytes(range(250)) * 4 and r.index() == b"index"
    raw[int(r.at[1]) + 20] ^= 1
    bad = tokenfile.SeekableReader(pa.BufferReader(bytes(raw)))
    assert bad.frame(0) == b"a" * 1000
    with pytest.raises(Exception):  # noqa: B017
        bad.frame(1)


def test_empty_table_query(spark, tmp_path):
    sf = table(spark, tmp_path, "documents", [], DOCS)
    assert op10_bpe(spark, sf).count() == 0 and op6_tokenfile(spark, sf).count() == 0


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_each_distinct_word_is_encoded_once(bpe, monkeypatch, most):
    """In one part of the table, over several blocks; with a lower bound it begins anew and gives the same."""
    import pyarrow as pa
    import zstandard

    from skerry.llm import bpe as B

    monkeypatch.setattr(B, "REMEMBERED", most)
    blocks = [["the", "quick"], ["the", "jinxed", "vampires"], ["quick", "the"], ["vampires"]]
    encoded = []
    once = type(bpe).encode
    monkeypatch.setattr(type(bpe), "encode", lambda self, ws: encoded.extend(ws) or once(self, ws))
    pack = zstandard.ZstdCompressor().compress
    batch = pa.RecordBatch.from_pydict({"bucket": [0] * 4, "block": [10, 11, 12, 13], "at": [b""] * 4, "words": [pack("\n".join(ws).encode()) for ws in blocks]})
    got = [r for b in B._encode_table(tokenizer_path())(iter([batch])) for r in b.to_pylist()]
    monkeypatch.undo()
    assert most == 3 or sorted(encoded) == sorted({w for ws in blocks for w in ws})
    for r, ws in zip(got, blocks, strict=True):
        low, high = B._unpack(r["ids"], "<u2").reshape(2, -1).astype(int)
        assert (low + (high << 16)).tolist() == [i for w in ws for i in library(bpe, [w])[0]]


def test_decode_of_stored_ids(spark, bpe):
    from pyspark.sql import functions as F

    from skerry.llm.bpe import decode

    ids = library(bpe, [t or "" for _, t, *_ in ODD])
    rows = [(d, i) for (d, *_), i in zip(ODD, ids, strict=True)] + [(70, None), (71, [1, 10**8, 1])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").withColumns({"id": F.lit(1), "piece": F.lit("x"), "_row": F.lit(2)})
    want = [(d, bpe.whole.decode([x for x in i or [] if x < len(bpe.pieces)], skip_special_tokens=False)) for d, i in rows]
    assert multiset(map(tuple, decode(df, tokenizer_path()).collect())) == multiset(want)
    assert decode(df.limit(0), tokenizer_path()).count() == 0


def test_vocabulary_decodes_any_file_with_special_strings(spark, bpe):
    from skerry.llm.bpe import vocabulary

    got = {r["id"]: r["piece"] for r in vocabulary(spark, tokenizer_path()).collect()}
    assert got == dict(enumerate(bpe.pieces)) and got[49407] == "<|endoftext|>"


def test_files_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "FILE_DOCS", 2)
    monkeypatch.setattr(tokenfile, "BATCH_BYTES", 40)
    rows = [(i, f"some words of text {i}", "en", "s", 1) for i in range(40)]
    folder = new_dir(spark, "files")
    files = tokenfile.write_tokens(docs(spark, rows), folder, tokenizer_path(), 2)
    assert len(files) > len({f["part"] for f in files}) and sum(f["docs"] for f in files) == 40
    got = sorted((r["doc_id"], r["start"], r["ids"]) for r in tokenfile.read_tokens(spark, folder).collect())
    at = 0
    for i, (d, start, ids) in enumerate(got):
        assert d == i and start == at and ids[-1] == 2
        at += len(ids)
    assert tokenfile.read_documents(folder, {7})[7].tolist() == got[7][2]


def test_shared_folder(spark):
    from types import SimpleNamespace

    from skerry.llm import common

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://x:1", getConf=lambda: SimpleNamespace(get=lambda *_: None)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(far)
    since = common.tables_made()
    a, b = common.cut(spark.range(3)), common.cut(spark.range(4))
    common.drop_tables(spark, since, but_last=True)
    assert b.count() == 4 and common.tables_made() == since + 1
    with pytest.raises(Exception, match="(?i)not.exist|not.found"):
        a.collect()
