"""SimHash near-duplicates through a Gray-order hierarchical index.

Two fingerprints within two bits agree on one of three 21-bit blocks at least.
For each block there is a table of all distinct fingerprints with that block's
bits moved to the front, sorted by Gray rank over its whole length and dealt in
ranges. A range is a tree: upper nodes hold the bits that their whole group
shares, children only what is left, and a search adds up differences on its way
down and drops a group as soon as they pass the radius, or touch the leading
block (the pair then stands in another table). All links come from that search.
Where many fingerprints share a leading block, they go on to tables that also
put a block of the remaining bits to the front, level by level, which bounds
the fingerprints under one leading pattern by 1,024.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import batches_of, cut, in_files, look_up, n_parts, numbered, place, row_hash, ship, strings

SHINGLE, SEED, RADIUS = 3, 42, 2
BATCH_BYTES = 2_000_000
#: Children of a node.
FAN = 8
#: Fingerprints under one leading pattern beyond which they go on to the next level of tables.
LARGE = 4096
#: Fingerprints of a range from which its next group begins a tree of its own.
RANGE = 8192
#: Width of the three blocks that each level may move to the front; what is left over (1, 1, 2, 2 and 2 bits) leads in no table.
WIDTHS = (21, 14, 9, 6, 4)


# --- fingerprints ---


def shingle_hashes(text: str, size: int = SHINGLE) -> list[int]:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) < size:
        return [xxhash.xxh64_intdigest(line, SEED)]
    starts = [0, *accumulate([len(w) + 1 for w in words])]
    stops = [s - 1 for s in starts[size:]]
    return list(map(xxhash.xxh64_intdigest, [line[a:z] for a, z in zip(starts, stops, strict=False)], repeat(SEED)))


def fingerprints(texts: list[str]) -> np.ndarray:
    """A bit is 1 if it is set in over half the shingles' hashes; 0 for a text without words."""
    return majority([np.array(shingle_hashes(t), np.uint64) for t in texts])


def majority(each: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each array of hashes."""
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    flat = np.concatenate(each) if each else np.zeros(0, np.uint64)
    out = np.zeros(len(each), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    begin = (np.cumsum(sizes) - sizes)[some]
    counts = np.zeros((len(some), 64), np.int64)
    step = 500_000  # bits unpacked at a time
    for a in range(0, len(flat), step):
        z = min(len(flat), a + step)
        bits = np.unpackbits(flat[a:z].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lo, hi = np.searchsorted(begin, a, side="right") - 1, np.searchsorted(begin, z, side="left")
        cuts = np.maximum(begin[lo:hi] - a, 0)
        counts[lo:hi] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    ones = counts * 2 > sizes[some][:, None]
    out[some] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


# --- the index ---


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    r = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Distinct 64-bit codes in Gray order under a tree of shared bit patterns.

    ``looked_at`` counts the codes that searches have compared with others.
    """

    def __init__(self, codes: np.ndarray):
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        self.looked_at = 0
        ones, zeros = self.codes, ~self.codes
        levels = [(ones, ones | zeros)]
        while len(ones) > FAN:
            starts = np.arange(0, len(ones), FAN)
            ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_and.reduceat(zeros, starts)
            levels.append((ones, ones | zeros))
        self.levels = []  # from the top: pattern, bits not in the parent, free bits below
        above = None
        for ones, mask in reversed(levels):
            own = mask if above is None else mask & ~np.repeat(above, FAN)[: len(mask)]
            self.levels.append((ones, own, 64 - np.bitwise_count(mask).astype(np.int16)))
            above = mask

    def links(self, radius: int = RADIUS, step: int = 512, every: bool = False, lead: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places in ``codes`` that join all codes within ``radius`` that agree on the first ``lead`` bits, transitively.

        A group whose every member is within the radius of the searching code,
        and hence of each other, gives one pair; with ``every``, all pairs come.
        """
        depth = len(self.levels)
        first = np.uint64(((1 << lead) - 1) << (64 - lead))
        for q0 in range(0, len(self.codes), step):
            q = np.arange(q0, min(q0 + step, len(self.codes)))
            node = np.tile(np.arange(len(self.levels[0][0])), len(q))
            who = np.repeat(q, len(self.levels[0][0]))
            diff = np.zeros(len(who), np.int16)
            for d, (pattern, own, free) in enumerate(self.levels):
                self.looked_at += len(who) if d == depth - 1 else 0
                bits = (self.codes[who] ^ pattern[node]) & own[node]
                diff = diff + np.bitwise_count(bits).astype(np.int16)
                width = FAN ** (depth - 1 - d)
                keep = (diff <= radius) & ((node + 1) * width > who)  # a pair is found from its first code
                if lead:
                    keep &= (bits & first) == 0
                who, node, diff = who[keep], node[keep], diff[keep]
                if every and d < depth - 1:
                    whole = np.zeros(len(diff), bool)
                else:
                    whole = diff + free[node] <= radius
                if whole.any():
                    a, b = who[whole], node[whole] * width
                    yield a[a != b], b[a != b]
                    if d == depth - 1:
                        break
                    who, node, diff = who[~whole], node[~whole], diff[~whole]
                if d < depth - 1:
                    size = len(self.levels[d + 1][0])
                    who, diff = np.repeat(who, FAN), np.repeat(diff, FAN)
                    node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    there = node < size
                    who, node, diff = who[there], node[there], diff[there]


def spanning(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The pairs that join two parts not joined before."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    out = []
    for x, y in zip(a, b, strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def leading(level: int) -> int:
    """Bits that all codes of a group of this level share at the front."""
    return sum(WIDTHS[: level + 1])


def _gray(code: Column) -> Column:
    for s in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, s))
    return code


def _tables(rows: DataFrame, level: int) -> DataFrame:
    """(level, table, group, rank, fp): each row's code three times, a block of its free bits moved to the front of these each time.

    ``group`` is the leading bits' own Gray rank, so that groups, and codes in them by ``rank``, stand in Gray order.
    """
    free = 64 - leading(level - 1)
    mask = F.lit((1 << free) - 1 if free < 64 else -1)
    tail = F.col("code").bitwiseAND(mask)
    turned = lambda s: F.shiftleft(tail, s).bitwiseOR(F.shiftrightunsigned(tail, free - s)).bitwiseAND(mask) if s else tail
    each = [F.struct((F.col("table") * 3 + i + 1).alias("table"), F.col("code").bitwiseAND(F.bitwise_not(mask)).bitwiseOR(turned(i * WIDTHS[level])).alias("code")) for i in range(3)]
    got = rows.select("fp", F.explode(F.array(*each)).alias("at")).select("fp", "at.table", "at.code")
    got = got.withColumn("rank", _gray(F.col("code")))
    return got.select(F.lit(level).alias("level"), "table", F.shiftrightunsigned("rank", 64 - leading(level)).alias("group"), "rank", "fp")


def search_range(codes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(codes, codes, number of comparisons): the links of a range of one table, which holds whole groups."""
    index = GrayIndex(codes)
    got = list(index.links(lead=leading(level)))
    left, right = (np.concatenate([index.codes[p[k]] for p in got]) if got else np.zeros(0, np.uint64) for k in (0, 1))
    return left, right, index.looked_at


def _search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (level, table, group, rank, fp) in order; a range ends where a group does, when it is long enough."""
    held: list[pa.RecordBatch] = []
    n = 0

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        level, table, rank, fp = (t.column(i).to_numpy() for i in (0, 1, 3, 4))
        ends = np.flatnonzero((table[1:] != table[:-1]) | (level[1:] != level[:-1])) + 1
        for a, z in zip([0, *ends.tolist()], [*ends.tolist(), len(table)], strict=True):
            r = np.ascontiguousarray(rank[a:z]).view(np.uint64)
            codes = r ^ (r >> np.uint64(1))
            order = np.argsort(codes)
            left, right, _ = search_range(codes, int(level[a]))
            own = fp[a:z][order]
            x, y = (own[np.searchsorted(codes[order], side)] for side in (left, right))
            pairs = spanning(x.tolist(), y.tolist())
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    for b in it:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < RANGE:
            continue
        last = np.ones(b.num_rows, bool)
        for i in range(3):
            col = b.column(i).to_numpy()
            last &= col == col[-1]
        at = b.num_rows - int(np.argmin(last[::-1])) if not last.all() else 0
        if at:
            held[-1] = b.slice(0, at)
            yield from solve(pa.Table.from_batches(held))
            held, n = [b.slice(at)], b.num_rows - at
    if held:
        yield from solve(pa.Table.from_batches(held))


def linked_pairs(codes: DataFrame) -> DataFrame:
    """(a, b) pairs of the distinct longs in ``fp`` that join all within two bits, transitively."""
    rows = codes.select("fp", F.lit(0).alias("table"), F.col("fp").alias("code"))
    dealt: DataFrame | None = None
    for level in range(len(WIDTHS)):
        keyed = _tables(rows, level)
        large = keyed.groupBy("table", "group").count().filter(F.col("count") > LARGE).select("table", "group")
        large = cut(large) if level + 1 < len(WIDTHS) else None
        more = large is not None and not large.isEmpty()
        own = keyed.join(large, ["table", "group"], "left_anti").select(keyed.columns) if more else keyed
        dealt = own if dealt is None else dealt.unionByName(own)
        if not more:
            break
        rank = F.col("rank")
        rows = cut(keyed.join(large, ["table", "group"], "left_semi").select("fp", "table", rank.bitwiseXOR(F.shiftrightunsigned(rank, 1)).alias("code")))
    ordered = dealt.repartitionByRange(n_parts(codes.sparkSession), "level", "table", "group").sortWithinPartitions("level", "table", "group", "rank")
    return ordered.mapInArrow(_search, "a long, b long")


# --- components ---


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges (a, b)``; the label is the same for all nodes that are joined.

    Every node takes its smallest neighbour, chains of these are shortened by
    doubling, and the edges shrink to those between what remains: at least half
    of the nodes go each time. All steps are joins and pre-aggregated sums;
    results are cut by checkpoints.
    """
    edges = cut(edges.filter("a <> b").distinct())
    put_by = lambda df, n=2 * edges.count(): cut(in_files(df, n))  # noqa: E731  an edge has two nodes at most
    label = put_by(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node")))
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        up = put_by(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")))
        while True:
            over = up.select(F.col("node").alias("to"), F.col("to").alias("far"))
            nxt = put_by(look_up(up, over, "to").select("node", "far", F.col("to").alias("was")))
            moved = not nxt.filter("far <> was").isEmpty()
            up = nxt.select("node", F.col("far").alias("to"))
            if not moved:
                break
        put = lambda df, col: look_up(df, up.select(F.col("node").alias(col), F.col("to").alias("_t")), col).withColumn(col, F.coalesce("_t", col)).drop("_t")
        label = put_by(put(label, "label"))
        edges = put_by(put(put(edges, "a"), "b").filter("a <> b").distinct())
    return label


# --- the operator ---


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (long) and ``component_id`` of every row.

    The component is the smallest document id that links of at most two
    differing bits reach. Null text: empty, with fingerprint 0, linked like any
    other. Null ids are passed over for the smallest id (null if there is none).
    Repeated rows give a row each; other columns are left out; an empty table
    gives an empty one. One fingerprint or one group of near copies may hold
    any share of the rows: equal fingerprints are pre-aggregated first.
    """
    ship(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it, "text", BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(strings(b.column(1))).view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fps = cut(rows.mapInArrow(run, "doc_id long, fp long"))
    codes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    label = components(linked_pairs(codes.select("fp")))
    joined = cut(codes.join(label, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("label", "fp").alias("label")))
    least = cut(joined.groupBy("label").agg(F.min("first").alias("component_id")))
    of = cut(look_up(joined, least, "label").select("fp", "component_id"))
    return look_up(fps, of, "fp").select("doc_id", "fp", "component_id")


# --- near copies by similarity ---

#: Words of a shingle, and the least similarity: the cosine of two texts' sets of shingles, which is what SimHash bits estimate
#: (sets of equal size then share two thirds of their union).
SIMILAR_WORDS, SIMILARITY = 5, 0.8
#: Differing bits within which two texts are compared; at similarity 0.8 the expected number is 13 with a deviation of 3.2, so that
#: one pair in 3,000 lies beyond.
WIDE = 24
#: Smallest shingles, each in an order of its own, that texts meet under. Texts share one with a probability of the shared part of
#: their union, 0.64 at least: one pair in 450 of those just at the threshold shares none.
ANCHORS = 6
#: Texts, and bytes of their shingle sets, that meet at once; a larger group is divided by sizes and by pairs of blocks, without loss.
CROWD, CROWD_BYTES = 20_000, 32_000_000
#: Texts of shared anchors up to which their keys are broadcast (8 bytes each).
BROADCAST_TEXTS = 1_000_000
_ORDERS = np.array([xxhash.xxh64_intdigest(bytes([i]), 101) | 1 for i in range(ANCHORS)], np.uint64)


def similarity_rows(texts: list[str]) -> tuple[list[int], np.ndarray, list[list[int]], list[bytes]]:
    """(hash of the words, fingerprint, anchors, set of shingles) of each text; sets are of 32-bit halves of the hashes."""
    sets = [np.unique(np.array(shingle_hashes(t, SIMILAR_WORDS), np.uint64)) for t in texts]
    keys = [int(np.uint64(xxhash.xxh64_intdigest(b" ".join(t.encode("utf-8", "surrogatepass").lower().split()), 9)).astype(np.int64)) for t in texts]
    anchors = [(s[:, None] * _ORDERS[None, :]).min(axis=0).view(np.int64).tolist() if len(s) else [] for s in sets]
    return keys, majority(sets), anchors, [np.unique(s.astype(np.uint32)).tobytes() for s in sets]


def similar_pairs(codes: np.ndarray, sets: list[np.ndarray], threshold: float = SIMILARITY) -> list[tuple[int, int]]:
    """Pairs of places that join all texts of a group whose shingle sets are similar, transitively.

    Pairs within WIDE bits come from the index, nearest first; a pair of one
    part already isn't compared again.
    """
    order = np.argsort(gray_rank(codes), kind="stable")
    label = np.arange(len(codes))
    out = []
    for left, right in GrayIndex(codes).links(WIDE, 256, every=True) if len(codes) > 1 else ():
        a, b = order[left], order[right]
        near = np.argsort(np.bitwise_count(codes[a] ^ codes[b]), kind="stable")
        a, b = a[near], b[near]
        while len(a):
            open_ = label[a] != label[b]
            a, b = a[open_], b[open_]
            done = joined = 0
            for x, y in zip(a[:50_000].tolist(), b[:50_000].tolist(), strict=True):
                done += 1
                n, m = len(sets[x]), len(sets[y])
                if label[x] == label[y] or min(n, m) < threshold**2 * max(n, m) - 1e-9:
                    continue
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if both >= threshold * math.sqrt(n * m) - 1e-9:
                    label[label == label[y]] = label[x]
                    out.append((x, y))
                    joined += 1
                    if joined == 16:  # what these have closed is put away at once
                        break
            a, b = a[done:], b[done:]
    return out


def _groups(it: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole groups of rows that are sorted by their first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in it:
        rows = list(zip(*(b.column(i).to_pylist() for i in range(keys)), strict=True))
        at = 0
        for i, k in enumerate(rows):
            if k != last and (held or i > at):
                if i > at:
                    held.append(b.slice(at, i - at))
                yield pa.Table.from_batches(held)
                held, at = [], i
            last = k
        if len(rows) > at:
            held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _join_similar(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _groups(it, 2):
        if t.num_rows < 2:
            continue
        keys = t.column(2).to_pylist()
        codes = np.array(t.column(3).to_pylist(), np.int64).view(np.uint64)
        pairs = similar_pairs(codes, [np.frombuffer(x, np.uint32) for x in t.column(4).to_pylist()])
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([keys[x] for x, _ in pairs], pa.int64()), pa.array([keys[y] for _, y in pairs], pa.int64())], ["a", "b"])


def divided(crowded: DataFrame) -> DataFrame:
    """(key, fp, slot, anchor): groups of at most about 2 x CROWD texts in which all pairs meet that can be similar.

    ``crowded`` has key, fp, n (the size of the shingle set), slot and anchor.
    Sets of similarity SIMILARITY differ in size by its square at most: with
    bands a little wider they lie in one band or in two that follow each other,
    so each set goes to its own band and to the next. A band's texts are dealt
    to blocks by hash, and every two blocks make a group.
    """
    band = F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / -math.log(SIMILARITY**2 - 0.01))
    by_band = crowded.select("key", "fp", "n", "slot", "anchor", F.explode(F.array(band, band + 1)).alias("band"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / CROWD, F.sum("n") * 4 / CROWD_BYTES)).cast("int")
    sizes = cut(by_band.groupBy("slot", "anchor", "band").agg(F.count(F.lit(1)).alias("count"), blocks.alias("blocks")).filter("count > 1"))
    dealt = by_band.join(F.broadcast(sizes), ["slot", "anchor", "band"]).withColumn("mine", F.pmod(F.xxhash64("key", F.lit(7)), F.col("blocks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: (i != F.col("mine")) | (F.col("blocks") == 1))
    pairs = dealt.select("key", "fp", "slot", "anchor", "band", "mine", F.explode(others).alias("other"))
    group = F.xxhash64("anchor", "band", F.least("mine", "other"), F.greatest("mine", "other"))
    return pairs.select("key", "fp", (F.col("slot") + 100).alias("slot"), group.alias("anchor"))


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``component_id`` of every row: texts of five-word cosine similarity 0.8 or more are joined, transitively.

    Equal texts (but for case and white space) are one before anything is
    compared. Texts that share one of their anchors meet in a group, where the
    Gray-order index over their SimHashes gives the pairs within WIDE bits, and
    exact similarity of their shingle sets decides. Only anchors that two texts
    share are looked at; a group of any size is compared whole, in parts that
    fit a task. Null texts are empty and one group with other texts without words;
    null ids are passed over for the smallest id; repeated rows give a row each,
    very long texts are compared whole; other columns, whatever their names, are
    left out; an empty table gives an empty one.
    """
    rows, joined, least = _similar(docs, id_col, text_col)
    of = cut(look_up(joined.select("key", "label"), least, "label").select("key", F.col("first.doc_id").alias("component_id")))
    return look_up(rows.select("doc_id", "key"), of, "key").select("doc_id", "component_id")


def _similar(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows (doc_id, text_hash, row_hash, key and more), each text's (key, label), and each label's ``first`` row by id (null last) and hashes."""
    spark = docs.sparkSession
    ship(spark)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it, "text", BATCH_BYTES):
            keys, fps, anchors, sets = similarity_rows(strings(b.column(1)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), pa.array(keys, pa.int64()), pa.array(fps.view(np.int64)), pa.array(anchors, pa.list_(pa.int64())), pa.array(sets, pa.binary())],
                ["doc_id", "text_hash", "row_hash", "key", "fp", "anchors", "shingles"],
            )

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"), row_hash(docs).alias("row_hash"))
    rows = cut(rows.mapInArrow(run, "doc_id long, text_hash long, row_hash long, key long, fp long, anchors array<long>, shingles binary"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "row_hash")).alias("first")
    n = rows.count()
    texts = cut(in_files(rows.groupBy("key").agg(first, F.min("fp").alias("fp"), F.min("anchors").alias("anchors"), F.min(F.length("shingles") / 4).cast("long").alias("n")), n))
    under = texts.select("key", "fp", "n", F.posexplode("anchors").alias("slot", "anchor")).withColumn("anchor", F.xxhash64("slot", "anchor"))
    shared = cut(in_files(under.groupBy("slot", "anchor").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("n")).filter("count > 1"), 6 * n))
    crowd = (F.col("count") > CROWD) | (F.col("n") * 4 > CROWD_BYTES)
    if not shared.filter(crowd).isEmpty():
        usual = under.join(shared.filter(~crowd), ["slot", "anchor"], "left_semi").select("key", "fp", "slot", "anchor")
        members = cut(usual.unionByName(divided(under.join(F.broadcast(shared.filter(crowd)), ["slot", "anchor"], "left_semi"))))
    else:
        members = cut(in_files(under.join(shared, ["slot", "anchor"], "left_semi").select("key", "fp", "slot", "anchor"), 6 * n))
    wanted = cut(in_files(members.select("key").distinct(), n))
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_TEXTS else wanted
    sets = cut(rows.join(few, "key", "left_semi").groupBy("key").agg(F.min("shingles").alias("shingles")))
    dealt = members.join(sets, "key").select("slot", "anchor", "key", "fp", "shingles").repartition(n_parts(spark), "slot", "anchor").sortWithinPartitions("slot", "anchor", "key")
    label = components(dealt.mapInArrow(_join_similar, "a long, b long"))
    joined = cut(in_files(texts.join(label, F.col("key") == F.col("node"), "left").select("key", "first", F.coalesce("label", "key").alias("label")), n))
    least = cut(in_files(joined.groupBy("label").agg(F.min("first").alias("first")), n))
    return rows, joined, least


def hex_of(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of similar texts: that of its smallest document id, null last.

    Of several rows of that id the one of the smallest hash of its text, then
    of all its columns, stays; of rows equal in all columns one. Rows of null
    ids are documents of their own. Null and empty texts are one group; ties
    fall by those hashes, whatever the order of rows; very long texts are read
    whole; all columns stay as they are, whatever their names; an empty table
    gives an empty one.
    """
    plain = numbered(docs)
    i, t = place(docs, id_col), place(docs, text_col)
    rows, _, least = _similar(plain, i, t)
    keep = least.select(*[F.col(f"first.{c}").alias(f"first_{c}") for c in ("doc_id", "text_hash", "row_hash")])
    keys = {"doc_id": F.col(i).cast("long"), "text_hash": F.xxhash64(F.col(t).cast("string")), "row_hash": row_hash(plain)}
    same = F.col("doc_id").eqNullSafe(F.col("first_doc_id")) & (F.col("text_hash") == F.col("first_text_hash")) & (F.col("row_hash") == F.col("first_row_hash"))
    # as many as the documents that stay: never broadcast
    out = plain.withColumns(keys).join(keep.hint("merge"), same, "left_semi")
    repeated = rows.groupBy("doc_id", "text_hash", "row_hash").count().filter("count > 1")
    out = out if repeated.isEmpty() else out.dropDuplicates(list(keys))
    return out.select(*plain.columns).toDF(*docs.columns)
