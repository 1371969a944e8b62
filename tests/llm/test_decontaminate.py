import random
from collections import Counter, defaultdict

import regex
from conftest import SF
from helpers import DOCS, ODD, PASSAGE, docs, multiset, table
from oracle import differences, duck

from skerry.llm import decontaminate as D
from skerry.llm.common import read_table
from skerry.llm.decontaminate import drop_leaks, leaks
from skerry.llm.queries_decontaminate import OP1_SQL, op1_decontaminate

ITEMS = "item_id long, text string"
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def shingles(t):
    w = WORD.findall((t or "").lower())
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])


def brute(docs_, items, threshold=0.8):
    its = [(i, Counter(s), len(s)) for i, t in items if (s := shingles(t))]
    by = defaultdict(list)
    for k, (_, c, _) in enumerate(its):
        for h in c:
            by[h].append(k)
    out = {}
    for d, t, *_ in docs_:
        s = shingles(t)
        for p in range(len(s)):
            for i, c, m in (its[k] for k in by[s[p]]) if s[p] in by else ():
                shared, left = 0, Counter(c)
                for q in range(p, min(len(s), p + 5 * m // 4 + 1)):
                    if left[s[q]] > 0:
                        left[s[q]] -= 1
                        shared += 1
                    sim = shared / (m + q - p + 1 - shared)
                    if sim >= threshold - 1e-12:
                        out[d, i] = max(out.get((d, i), 0), round(sim, 9))
    return out


def found(rows):
    return {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in rows}


def test_equals_sql(spark):
    assert differences(spark, duck(SF), op1_decontaminate, OP1_SQL, SF) == []


ITEM_ROWS = [(1, PASSAGE), (1, PASSAGE), (2, "short item"), (3, None), (4, ""), (5, PASSAGE + " and some further words that make it quite a bit longer than it was"), (None, "plain text with some words mail"), (6, "a b c a b c a b c a b c a b c")]


def test_odd_rows(spark):
    items = spark.createDataFrame(ITEM_ROWS, ITEMS)
    rows = [*ODD, (20, "short, ITEM!", None, None, None), (21, "a b c " * 9, None, None, None), (22, " ".join(PASSAGE.split()[:-3]), None, None, None), (None, PASSAGE, None, None, None)]
    assert found(leaks(docs(spark, rows), items).collect()) == brute(rows, ITEM_ROWS)
    assert leaks(docs(spark).limit(0), items).count() == 0 and leaks(docs(spark), items.limit(0)).count() == 0


def test_edited_passages(spark, tmp_path):
    """Random edits around the threshold: what brute force finds is found."""
    rnd = random.Random(6)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(20, 60)))) for i in range(30)]
    rows = []
    for d in range(150):
        w = [rnd.choice(vocab) for _ in range(40)]
        x = rnd.choice(items)[1].split()
        for _ in range(rnd.randint(0, 2)):
            k = rnd.randrange(len(x))
            x[k : k + rnd.randint(0, 1)] = [rnd.choice(vocab)]
        a, z = rnd.choice(((0, len(x)), (rnd.randint(0, 5), len(x)), (0, len(x) - rnd.randint(0, 5))))
        rows.append((d, " ".join(w[:20] + x[a:z] + w[20:]), "en", "s", 1))
    sf = table(spark, tmp_path, "documents", rows, DOCS)
    table(spark, tmp_path, "benchmark", items, ITEMS)
    want = brute(rows, items)
    got = found(op1_decontaminate(spark, sf).collect())
    assert got == {k: v for k, v in want.items() if k in got} and len(got) >= 0.99 * len(want) > 40


def simhash_256(s):
    """By the definition: bit by bit over the hashes that the operator's first step gives."""
    return sum((sum(h >> b & 1 for h in s) * 2 > len(s)) << b for b in range(64))


def test_fingerprints_by_definition(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([3, -1, 5, 1 << 62, 3],), ([7],), (list(range(-300, 300)),)], "hs array<long>")
    seeded = lambda k: F.transform("hs", lambda h: F.xxhash64(h, F.lit(k)))
    hashes = [F.col("hs"), *[seeded(k) for k in range(1, 4)]]
    for r in df.select(D.lanes("hs").alias("fp"), *[h.alias(f"h{k}") for k, h in enumerate(hashes)]).collect():
        want = [simhash_256([x % (1 << 64) for x in r[f"h{k}"]]) >> 16 * i & 0xFFFF for k in range(4) for i in range(4)]
        assert r["fp"] == want


def test_the_index_is_selective_and_whole_within_its_radius(spark):
    """All pairs of windows and items of one size within RADIUS bits are candidates; of the rest under one pair in a hundred is."""
    docs_, bench = read_table(spark, SF, "documents"), read_table(spark, SF, "benchmark")
    from pyspark.sql import functions as F

    items = D.cut(D.items_of(bench, "item_id", "text").withColumn("item_no", F.monotonically_increasing_id()))
    wins = D.cut(D.windows(docs_, items, "doc_id", "text"))
    met = {(r["doc_id"], r["start"], r["m"], r["item_id"]) for r in D.candidates(wins, items).select("doc_id", "start", "m", "item_id").collect()}
    all_items, near, n = items.collect(), set(), 0
    for w in wins.select("doc_id", "start", "m", "fp").collect():
        n += 1
        for i in all_items:
            if i["m"] == w["m"] and sum((a ^ b).bit_count() for a, b in zip(w["fp"], i["fp"], strict=True)) <= D.RADIUS:
                near.add((w["doc_id"], w["start"], w["m"], i["item_id"]))
    assert D.RADIUS == 47 and near <= met and near and len(met - near) < 0.01 * n * len(all_items)


def test_benchmark_in_parts(spark, monkeypatch):
    want = multiset(map(tuple, op1_decontaminate(spark, SF).collect()))
    monkeypatch.setattr(D, "PART_ITEMS", 9)
    assert multiset(map(tuple, op1_decontaminate(spark, SF).collect())) == want


def test_drop_leaks_tells_rows_of_one_id_apart(spark):
    rows = [(1, PASSAGE, "en", "s", 1), (1, "clean words only", "en", "s", 1), (None, PASSAGE, "en", "s", 1), (None, "clean words only", "en", "s", 1), (None, None, None, None, None)]
    got = drop_leaks(docs(spark, rows), spark.createDataFrame(ITEM_ROWS[:1], ITEMS)).collect()
    assert multiset((r["doc_id"], r["text"]) for r in got) == multiset([(1, "clean words only"), (None, "clean words only"), (None, None)])


def test_drop_leaks(spark):
    d = docs(spark)
    items = spark.createDataFrame(ITEM_ROWS[:1], ITEMS)
    got = drop_leaks(d, items)
    assert got.schema == d.schema
    assert multiset((r["doc_id"], r["text"]) for r in got.collect()) == multiset((r[0], r[1]) for r in ODD if r[0] != 8)
