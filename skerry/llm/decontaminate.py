"""Benchmark decontamination with SimHash windows, by DataFrame functions alone.

Words are runs of letters, marks and digits, lower-cased; features are five-word
shingles (a shorter text is one shingle), weighted by how often they occur.

1. An item-sized window has as many shingles as an item. A window that leaks
   an item begins, once what it doesn't share is cut off its front, with one of
   the item's shingles: windows stand wherever a document has a benchmark
   shingle, in the sizes of the items that have it. No leak is lost by that.
2. Each window gets a SimHash of BITS bits over all its shingles. It is held
   in blocks of 16 bits; the index has each item's blocks under its size, with
   all blocks that differ in up to PROBE bits. Any two fingerprints within
   RADIUS differing bits meet in a block. Pairs that meet are candidates, once
   each, those beyond the radius too.
3. A candidate passes by exact weighted-shingle similarity, shared over united
   weight, of the item and the window that begins there and ends where it is
   most similar, at ``threshold`` or more.

All is joined to broadcast tables of the benchmark, in parts of bounded size:
documents are read once a part, and only leaks are shuffled.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import cut, numbered, place

SHINGLE, THRESHOLD = 5, 0.8
#: A fingerprint: four 64-bit hashes of each shingle, so 16 blocks of 16 bits.
HASHES, BITS, BLOCK = 4, 256, 16
#: Bits by which a block may differ, on the items' side: 137 entries a block. 16 blocks of at most 2 differing bits each hold any radius below 48.
PROBE = 2
RADIUS = (PROBE + 1) * BITS // BLOCK - 1
#: Shingles of the items that one part of the benchmark holds, 1/20 as many items at most: its broadcast tables are bounded by
#: 16 bytes and a list of sizes a shingle, and by 2,192 entries of 24 bytes an item (a longer item is a part of its own).
PART_SHINGLES, PART_ITEMS = 400_000, 500
#: Flips of a block's bits that the index holds.
FLIPS = [sum(1 << b for b in at) for n in range(PROBE + 1) for at in combinations(range(BLOCK), n)]


def words(text: str) -> Column:
    line = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))
    return F.filter(F.split(line, " "), lambda w: w != "")


def shingles(text: str) -> Column:
    """64-bit hashes of the five-word shingles.

    The words' hashes are bound by an outer lambda: an expression that the
    optimizer copies into a filter then still computes them once a row.
    """
    none = F.array().cast("array<bigint>")

    def of(ws: Column) -> Column:
        n = F.size(ws)
        many = F.transform(F.sequence(F.lit(1), n - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(ws, i, SHINGLE)))
        return F.when(n >= SHINGLE, many).when(n > 0, F.array(F.xxhash64(ws))).otherwise(none)

    return F.element_at(F.transform(F.array(F.transform(words(text), lambda w: F.xxhash64(w))), of), 1)


def lanes(hashes: str) -> Column:
    """Blocks of the SimHash of an array of longs: bit b of a 64-bit hash is 1 if over half of the array have it.

    Bits are counted 16 apart, four counts in one long (up to 65,535 shingles each), so that a block's bit k is a lane of count k.
    """
    last = BLOCK - 1
    counts = f"transform(sequence(0, {last}), k -> aggregate(own, 0L, (a, h) -> a + (shiftrightunsigned(h, k) & {0x0001000100010001}L)))"
    block = f"aggregate(sequence(0, {last}), 0L, (a, k) -> a | if(2 * (shiftrightunsigned(c[k], {BLOCK} * i) & 65535L) > size(own), shiftleft(1L, k), 0L))"
    of_hash = f"element_at(transform(array({counts}), c -> transform(sequence(0, {64 // BLOCK - 1}), i -> {block})), 1)"
    seeded = "if(s = 0, hs, transform(hs, h -> xxhash64(h, s)))"
    return F.expr(f"element_at(transform(array({hashes}), hs -> flatten(transform(sequence(0, {HASHES - 1}), s -> element_at(transform(array({seeded}), own -> {of_hash}), 1)))), 1)")


def items_of(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, m, counts of its shingles, hs, fp) of the items that have words; repeated rows are one."""
    rows = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("_text")).distinct()
    got = rows.withColumn("_sh", shingles("_text")).filter(F.size("_sh") > 0)
    counts = F.transform(F.array_distinct("_sh"), lambda h: F.struct(h.alias("h"), F.size(F.filter("_sh", lambda x: x == h)).alias("n")))
    return got.select("item_id", F.size("_sh").alias("m"), counts.alias("counts"), F.array_distinct("_sh").alias("hs"), lanes("_sh").alias("fp"))


def windows(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, start, m, own, fp): every item-sized window that begins with a shingle of an item of its size.

    ``own`` goes on to the length that a window of this similarity can have at most.
    """
    index = F.broadcast(items.select("m", F.explode("hs").alias("h")).groupBy("h").agg(F.collect_set("m").alias("sizes")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    rows = rows.select("doc_id", F.xxhash64("_text").alias("text_hash"), shingles("_text").alias("_sh"))
    # outer: else a filter on the array's size would compute all shingles once more
    hits = rows.select("doc_id", "text_hash", "_sh", F.posexplode_outer("_sh").alias("pos", "h")).join(index, "h")
    most = F.ceil(F.array_max("sizes") / F.lit(threshold)).cast("int")
    hits = hits.select("doc_id", "text_hash", F.col("pos").cast("long").alias("start"), "sizes", F.slice("_sh", F.col("pos") + 1, most).alias("_own"))
    each = hits.select("doc_id", "text_hash", "start", F.explode("sizes").alias("m"), "_own")
    own = F.slice("_own", F.lit(1), F.ceil(F.col("m") / F.lit(threshold)).cast("int")).alias("own")
    return each.select("doc_id", "text_hash", "start", "m", own, lanes("slice(_own, 1, m)").alias("fp"))


def _place(m: Column, block: Column, bits: Column) -> Column:
    """Key of a block's bits under an item size."""
    return (m.cast("long") * (BITS // BLOCK) + block) * (1 << BLOCK) + bits


def candidates(wins: DataFrame, items: DataFrame) -> DataFrame:
    """Each window with each item of its size that it meets in a block, once: at the first block that is near."""
    flips = F.lit(FLIPS).cast("array<bigint>")
    entries = items.select("item_no", "m", F.posexplode("fp").alias("block", "bits"))
    entries = entries.select("item_no", F.explode(F.transform(flips, lambda f: _place(F.col("m"), F.col("block"), F.col("bits").bitwiseXOR(f)))).alias("place"))
    # outer: else a filter on the size of fp would compute it once more
    probes = wins.select("*", F.posexplode_outer("fp").alias("_block", "_bits"))
    met = probes.withColumn("place", _place(F.col("m"), F.col("_block"), F.col("_bits"))).join(F.broadcast(entries), "place")
    known = items.select("item_no", "item_id", "counts", F.col("hs").alias("item_hs"), F.col("fp").alias("item_fp"))
    met = met.join(F.broadcast(known), "item_no")
    before = F.slice(F.zip_with("fp", "item_fp", lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= PROBE), F.lit(1), F.col("_block"))
    return met.filter(~F.exists(before, lambda near: near))


def similarity(threshold: float) -> Column:
    """(similarity, size) of the best window from ``start`` on: it ends where the similarity to the item is highest, of ties first.

    A shingle counts as shared as often as the item has it, at its first places in the window.
    """
    is_shared = F.transform("own", lambda h: F.array_contains("item_hs", h))
    # how many are the item's at all bounds the similarity: most candidates of other items end here
    could = F.size(F.filter(is_shared, lambda x: x)) >= threshold * F.col("m") - 1e-9
    exact = F.expr(
        """aggregate(sequence(1, size(own)), named_struct('shared', 0L, 'best', 0D, 'size', 0), (a, j) ->
             if(exists(counts, c -> c.h = own[j - 1] and size(filter(slice(own, 1, j), x -> x = c.h)) <= c.n),
                if((a.shared + 1) / (m + j - a.shared - 1) > a.best, named_struct('shared', a.shared + 1, 'best', (a.shared + 1) / (m + j - a.shared - 1), 'size', j),
                   named_struct('shared', a.shared + 1, 'best', a.best, 'size', a.size)), a))"""
    )
    return F.when(could, exact)


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """(doc_id, text_hash, item_id, start, similarity): the best window of each document for each item that it leaks.

    ``start`` counts words from 0, ``text_hash`` tells texts of equal or null
    document ids apart. Null and empty texts have no shingle and leak nothing;
    a text or item of fewer than five words is one shingle and only equals its
    like; repeated rows give one row; of tied windows the first counts; very
    long texts are read whole; other columns, whatever their names, are left
    out; an empty table on either side gives no row. One passage may stand in
    any share of the documents: nothing is gathered by passage or item.
    """
    items = cut(items_of(benchmark, item_col, item_text))
    size = items.agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("n")).first()
    parts = max(1, -(-(size["m"] or 0) // PART_SHINGLES), -(-size["n"] // PART_ITEMS))
    items = cut(items.withColumn("part", F.pmod(F.xxhash64("item_id", "hs"), F.lit(parts))).withColumn("item_no", F.monotonically_increasing_id()))
    found: DataFrame | None = None
    for k in range(parts):
        own = items.filter(F.col("part") == k) if parts > 1 else items
        met = candidates(windows(docs, own, id_col, text_col, threshold), own)
        got = met.select("doc_id", "text_hash", "item_id", "start", similarity(threshold).alias("s")).filter(F.col("s.best") >= threshold)
        found = got if found is None else found.unionByName(got)
    best = F.max(F.struct(F.col("s.best").alias("similarity"), (-F.col("start")).alias("back"))).alias("best")
    got = found.groupBy("doc_id", "text_hash", "item_id").agg(best)
    return got.select("doc_id", "text_hash", "item_id", (-F.col("best.back")).alias("start"), F.col("best.similarity").alias("similarity"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no item; all columns stay as they are, whatever their names.

    Null and empty texts leak nothing and stay; a row is told by its id (null
    equals null) and the hash of its text, so that of rows under one id only
    those whose own text leaks go; repeated rows go or stay alike; very long
    texts are read whole; an empty benchmark drops none, an empty table gives
    an empty one.
    """
    plain = numbered(docs)
    i, t = place(docs, id_col), place(docs, text_col)
    bad = cut(leaks(plain, benchmark, i, t).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct())
    good = plain.join(bad, F.col(i).eqNullSafe(F.col("bad_id")) & (F.xxhash64(F.col(t).cast("string")) == F.col("bad_hash")), "left_anti")
    return good.toDF(*docs.columns)
