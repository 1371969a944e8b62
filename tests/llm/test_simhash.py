import random
import re

import numpy as np
import pytest
import xxhash
from conftest import SF
from helpers import DOCS, ODD, docs, multiset, table

from skerry.llm import simhash as S
from skerry.llm.common import read_table
from skerry.llm.queries_simhash import op7_simhash


def brute_fp(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t)
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in ([" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)])]
    return sum((sum(h >> b & 1 for h in hs) * 2 > len(hs)) << b for b in range(64))


def parts(codes, links):
    p = {int(c): int(c) for c in codes}

    def root(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        a, b = root(int(a)), root(int(b))
        p[max(a, b)] = min(a, b)
    return {c: root(c) for c in p}


def all_links(codes):
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2
    return [(codes[i], codes[j]) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)]


def clusters(seed, n=5, size=200):
    rnd = random.Random(seed)
    out = set()
    for _ in range(n):
        b = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, size)):
            c = b
            for _ in range(rnd.randint(0, 6)):
                c ^= 1 << rnd.randrange(rnd.choice((6, 64)))
            out.add(c)
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("seed", range(12))
def test_index_joins_what_brute_force_joins(seed):
    codes = clusters(seed)
    index = S.GrayIndex(codes)
    left, right = (np.concatenate([index.codes[p[k]] for p in index.links()] or [codes[:0]]) for k in (0, 1))
    left, right = left.tolist(), right.tolist()
    assert all((a ^ b).bit_count() <= 2 for a, b in zip(left, right, strict=True))
    assert parts(codes, zip(left, right, strict=True)) == parts(codes, all_links(codes))


def test_gray_rank():
    n = np.arange(1000, dtype=np.uint64)
    assert (S.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


@pytest.mark.parametrize(("large", "rows"), [(4096, 8192), (4096, 50), (20, 8192), (3, 5)])
def test_pairs_with_large_groups_dealt_again(spark, monkeypatch, large, rows):
    monkeypatch.setattr(S, "LARGE", large)
    monkeypatch.setattr(S, "RANGE", rows)
    codes = clusters(99, 8, 120)
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    got = [(np.int64(r["a"]).view(np.uint64), np.int64(r["b"]).view(np.uint64)) for r in S.linked_pairs(df).collect()]
    assert parts(codes, got) == parts(codes, all_links(codes))


def test_the_index_looks_at_few_and_finds_all():
    """All links of a table come from its tree, which compares under one in a hundred of all pairs."""
    rnd = np.random.default_rng(8)
    codes = rnd.integers(0, 1 << 64, 8000, dtype=np.uint64)
    near = codes[:300] ^ (np.uint64(1) << rnd.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 64, 300, dtype=np.uint64))
    codes = np.unique(np.concatenate((codes, near)))
    looked, found = 0, []
    for turn in (0, 21, 42):
        turned = (codes << np.uint64(turn)) | (codes >> np.uint64(64 - turn)) if turn else codes
        back = lambda c, s=turn: (c >> np.uint64(s)) | (c << np.uint64(64 - s)) if s else c
        a, b, n = S.search_range(turned, 0)
        looked += n
        found += list(zip(back(a).tolist(), back(b).tolist(), strict=True))
    assert looked < 0.01 * len(codes) ** 2 / 2
    assert parts(codes, found) == parts(codes, all_links(codes)) and len({tuple(sorted(p)) for p in found}) >= 290


def test_all_tables_share_their_leading_bits():
    """Two differing bits leave one block of each level untouched."""
    for level in range(len(S.WIDTHS)):
        free = 64 - S.leading(level - 1)
        assert 3 * S.WIDTHS[level] <= free and (level + 1 == len(S.WIDTHS) or S.leading(level) < 64)


@pytest.mark.parametrize("often", [50_000, 2])
def test_look_up(spark, monkeypatch, often):
    from skerry.llm import common

    monkeypatch.setattr(common, "OFTEN", often)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 9 + [2] * 4 + [3, 4, None, None, None])], "k long, i long")
    table_ = spark.createDataFrame([(1, "a"), (3, "c"), (9, "z")], "k long, v string")
    got = multiset(map(tuple, common.look_up(rows, table_, "k").collect()))
    assert got == multiset((r["k"], r["i"], {1: "a", 3: "c"}.get(r["k"])) for r in rows.collect())


@pytest.mark.parametrize("often", [50_000, 2])
def test_components_of_chains_and_stars(spark, monkeypatch, often):
    from skerry.llm import common

    monkeypatch.setattr(common, "OFTEN", often)
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (7000, 6999)]
    got = {r["node"]: r["label"] for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(201)}) == 1 and len({got[i] for i in range(1000, 1100)}) == 1 and len(set(got.values())) == 3
    assert S.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(rows):
    fps = {}
    for d, t, *_ in rows:
        fps.setdefault(brute_fp(t or ""), []).append(d)
    root = parts(fps, all_links(np.array(sorted(fps), np.uint64)))
    first = {}
    for f, ds in fps.items():
        first.setdefault(root[f], []).extend(d for d in ds if d is not None)
    return [(d, f"{brute_fp(t or ''):016x}", min(first[root[brute_fp(t or '')]], default=None)) for d, t, *_ in rows]


def test_op7_equals_brute_force(spark, tmp_path):
    rows = [tuple(r) for r in read_table(spark, SF, "documents").collect()]
    assert multiset(map(tuple, op7_simhash(spark, SF).collect())) == multiset(brute(rows))
    assert multiset(map(tuple, op7_simhash(spark, table(spark, tmp_path, "documents", ODD, DOCS)).collect())) == multiset(brute(ODD))
    assert op7_simhash(spark, table(spark, tmp_path, "documents", [], DOCS)).count() == 0


def test_long_text_in_steps():
    t = " ".join(f"w{i % 5003}" for i in range(20_000))
    assert int(S.fingerprints(["", t, "a b", t])[1]) == brute_fp(t)


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_similar(rows):
    """(id, smallest id of those that similarity joins) for rows with ids."""
    sets = [shingle_set(r[1]) for r in rows]
    p = list(range(len(rows)))

    def root(x):
        while p[x] != x:
            x = p[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (not sets[i] and not sets[j]) or both and both >= 0.8 * (len(sets[i]) * len(sets[j])) ** 0.5 - 1e-9:
                p[root(i)] = root(j)
    first = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            first[root(i)] = min(first.get(root(i), r[0]), r[0])
    return [(r[0], first.get(root(i))) for i, r in enumerate(rows)]


def edited(seed, n=120):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    base = [[rnd.choice(words) for _ in range(rnd.choice((3, 8, 60, 200)))] for _ in range(12)]
    rows = []
    for d in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice((0, 0, 1, 1, 2, 3))):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((d, " ".join(w).upper() if d % 3 == 0 else "  ".join(w), "en", "s", 1))
    return rows


@pytest.mark.parametrize("crowd", [20_000, 3])
def test_similar_texts_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(S, "CROWD", crowd)
    for rows in (edited(1), ODD, []):
        got = multiset((r["doc_id"], r["component_id"]) for r in S.similar_texts(docs(spark, rows)).collect())
        assert got == multiset(brute_similar(rows))


def test_crowded_groups_lose_no_pair(spark, monkeypatch):
    """Two texts of cosine similarity 0.89 whose only common anchor is that of a crowd."""
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(10**6)}"
    while True:
        a = [word() for _ in range(49)]
        b = [*a[:-5], *(word() for _ in range(5))]
        _, fps, (x, y), _ = S.similarity_rows([" ".join(a), " ".join(b)])
        same = [i for i in range(S.ANCHORS) if x[i] == y[i]]
        if len(same) == 1 and (int(fps[0]) ^ int(fps[1])).bit_count() <= S.WIDE:
            break
    at = same[0]
    passage = next(a[i : i + 5] for i in range(45) if S.similarity_rows([" ".join(a[i : i + 5])])[2][0][at] == x[at])
    texts = [" ".join(a), " ".join(b)]
    while len(texts) < 30:
        t = " ".join([*passage, *(word() for _ in range(rnd.choice((1, 3, 20, 44))))])
        if S.similarity_rows([t])[2][0][at] == x[at]:
            texts.append(t)
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    for crowd, most in ((4, S.CROWD_BYTES), (20_000, 400)):
        monkeypatch.setattr(S, "CROWD", crowd)
        monkeypatch.setattr(S, "CROWD_BYTES", most)
        got = {r["doc_id"]: r["component_id"] for r in S.similar_texts(docs(spark, rows)).collect()}
        assert got[1] == 0 and multiset(got.items()) == multiset(brute_similar(rows))


def test_all_pairs_of_the_index():
    codes = clusters(5)
    g = S.GrayIndex(codes)
    got = {tuple(sorted((int(g.codes[x]), int(g.codes[y])))) for a, b in g.links(20, 64, every=True) for x, y in zip(a, b, strict=True)}
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 20
    assert got == {tuple(sorted((int(codes[i]), int(codes[j])))) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)}


def test_keep_one(spark):
    for rows in (ODD, edited(2)):
        d = docs(spark, rows)
        got = S.keep_one(d)
        assert got.schema == d.schema
        ids = [r["doc_id"] for r in got.select("doc_id").collect()]
        assert multiset(ids) == multiset({c for i, c in brute_similar(rows) if c == i})


def test_keep_one_of_each_group_whatever_the_ids(spark):
    """Unlike texts of null ids, or of one id, all stay; of similar ones one does."""
    text = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"]
    near = text[0] + " more"
    rows = [(None, text[0], "en", "s", 1), (None, near, "en", "s", 1), (None, text[1], "en", "s", 1), (None, text[1], "en", "s", 1)]
    rows += [(9, text[2], "en", "s", 1), (9, text[3], "de", "s", 1), (9, text[3], "en", "s", 1), (8, text[4], "en", "s", 1), (None, text[4], "en", "s", 1), (7, text[5], "en", "s", 1)]
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        got = [tuple(r) for r in S.keep_one(docs(spark, rows, extra=False).repartition(3)).collect()]
        of_null = [t for d, t, *_ in got if d is None]
        assert len(of_null) == 2 and text[1] in of_null and (text[0] in of_null) != (near in of_null)
        assert multiset((d, t) for d, t, *_ in got if d is not None) == multiset([(9, text[2]), (9, text[3]), (8, text[4]), (7, text[5])])
        assert seed == 0 or multiset(got) == last
        last = multiset(got)
