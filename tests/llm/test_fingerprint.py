import hashlib
import random

from conftest import SF
from helpers import DOCS, ODD, docs, multiset, table

from skerry.llm.common import read_table
from skerry.llm.fingerprint import GEAR, LEAST, LOOSE_BITS, MOST, STRICT_BITS, USUAL, chunk_ends, containment, digest_sets, fingerprints, from_text, to_text, with_successors
from skerry.llm.queries_fingerprint import op2_fingerprint


def brute_ends(text: bytes) -> list[int]:
    """Byte by byte, the window of 32 bytes filled with zero bytes before the text."""
    out, start = [], 0
    data = bytes(32) + text
    for i in range(len(text)):
        h = 0
        for b in data[i + 1 : i + 33]:
            h = (2 * h + int(GEAR[b])) & 0xFFFFFFFF
        n = i + 1 - start
        if n >= MOST or n >= USUAL and h >> (32 - LOOSE_BITS) == 0 or n >= LEAST and h >> (32 - STRICT_BITS) == 0:
            out.append(i + 1)
            start = i + 1
    if start < len(text):
        out.append(len(text))
    return out


def test_chunks_equal_brute_force():
    rnd = random.Random(2)
    texts = [bytes(rnd.choice(b"abcde fgh") for _ in range(rnd.choice((0, 1, 15, 16, 40, 300, 3000)))) for _ in range(40)] + [b"x" * 2000, bytes(700)]
    gap = bytes(32)
    got, begin = chunk_ends([len(t) for t in texts], gap + gap.join(texts)), 32
    for t, ends in zip(texts, got, strict=True):
        assert [e - begin for e in ends] == brute_ends(t)
        begin += len(t) + 32


def test_shift_resistance_and_likeness():
    rnd = random.Random(3)
    t = " ".join(rnd.choice(("alpha", "beta", "gamma", "delta")) + str(rnd.randint(0, 999)) for _ in range(2000)).encode()
    a, b, c = digest_sets([t, b"inserted words " + t, t[::-1]])
    assert containment(a, b) > 0.95 and containment(a, c) < 0.05 and containment(a, a) == 1
    assert containment({}, {}) == 1 and containment(a, {}) == 0 and from_text(to_text(a)) == a and to_text({}) == ""


def check(rows, got):
    order = sorted(((d, t or "") for d, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for i, (d, t) in enumerate(order):
        n = order[(i + 1) % len(order)][1]
        h = len(t) // 2
        e = t[: len(t) - h] + n[:h]
        f, g, x = digest_sets([t.encode(), e.encode(), n.encode()])
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), to_text(f), to_text(g), containment(f, g), containment(f, x)))
    assert multiset(map(tuple, got)) == multiset(want)


def test_op2_equals_brute_force(spark):
    check([tuple(r) for r in read_table(spark, SF, "documents").collect()], op2_fingerprint(spark, SF).collect())


def test_op2_odd_rows(spark, tmp_path):
    check(ODD, op2_fingerprint(spark, table(spark, tmp_path, "documents", ODD, DOCS)).collect())
    one = [(5, "a lonely text", None, None, None)]
    check(one, op2_fingerprint(spark, table(spark, tmp_path, "documents", one, DOCS)).collect())
    assert op2_fingerprint(spark, table(spark, tmp_path, "documents", [], DOCS)).count() == 0


def test_many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        check([tuple(r) for r in read_table(spark, SF, "documents").collect()], op2_fingerprint(spark, SF).collect())
        ids = [r["id"] for r in with_successors(docs(spark)).filter("_ahead = 0").collect()]
        assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_fingerprints_of_odd_rows(spark):
    got = {(r["doc_id"], r["fingerprint"]) for r in fingerprints(docs(spark)).collect()}
    by = dict(got)
    assert by[1] == by[6] and by[2] == by[3] == "" and len(got) == 9


def test_ranks_among_bounds(spark):
    from pyspark.sql import functions as F

    from skerry.llm.common import _rank_in

    for edges in ([5], [1, 2], list(range(0, 300, 3)), [-7, -3, 0, 9, 10, 11, 50]):
        df = spark.range(-10, 310).select("id", _rank_in(F.col("id"), edges).alias("r"))
        assert all(r["r"] == sum(e <= r["id"] for e in edges) for r in df.collect())
