"""Keyword search over blocks of documents: an inverted index whose lists never leave their block.

A block is a run of documents of one partition, cut where it would have more than
a given number of postings. Its postings lists hold the documents' places in the block, so a block is searched by one task, with arrays
of its own size, and lists of different blocks never meet. Making the index
shuffles nothing; answering queries moves the lists of asked terms alone, once
for a batch of queries, and the best k of each query and block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.operators import lexical
from skerry.operators.lexical import Bm25
from skerry.sources.shared import ship

#: Queries of one pass: their ids and terms go to every task.
QUERIES = 4096
#: Bytes of what query terms give a block's documents that its task keeps for queries to come: more is computed again.
KEPT = 24 << 20
#: Postings of a block at most, unless a single document has more: what its task holds follows from these, however many or long the documents are.
POSTINGS = 1 << 20


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tie_col: str | None = None, postings: int = POSTINGS) -> DataFrame:
    """The index of documents with distinct ids: a row for each block and term, and one for each block alone.

    (block, term, place, tf, n, most_tf, least_dl, ids, dl, tie): ``place`` and
    ``tf`` are a list's documents and their counts; the row without a term has
    the block's document ids, lengths and, with ``tie_col``, a number each that
    decides ties before the id does. ``most_tf`` and ``least_dl`` bound what a
    list can add to a score whatever the mean length is. Documents without terms
    have no length and don't count. Null texts are empty. A
    block has ``postings`` of them at most, a single document may have more.
    """
    rows = lexical.doc_terms(docs, id_col, text_col, **({"tie": tie_col} if tie_col else {}))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.select("doc_id", "terms", "tfs", (F.col("tie").cast("long") if tie_col else F.lit(0).cast("long")).alias("tie"))

    def cut(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        upto, lo = b.column(1).offsets.to_numpy(), 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + postings, "right")) - 1)
            yield b.slice(lo, hi - lo)
            lo = hi

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for b in (part for whole in it for part in cut(whole)):
            dl = np.diff(b.column(1).offsets.to_numpy()).astype(np.int32)
            coded = b.column(1).flatten().dictionary_encode()
            code, tf = coded.indices.to_numpy(zero_copy_only=False), b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            by = np.argsort(code, kind="stable")
            place = np.repeat(np.arange(b.num_rows, dtype=np.int32), dl)[by]
            tf, n = tf[by], np.bincount(code, minlength=len(coded.dictionary)).astype(np.int32)
            first = np.concatenate(([0], np.cumsum(n)))
            lists = lambda x, ends: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), x)
            terms = len(n)
            some = terms > 0
            edge = lambda f, x: f.reduceat(x, first[:-1]) if some else np.zeros(0, np.int32)
            own = np.concatenate((np.zeros(terms + 1, np.int32), [b.num_rows]))  # lists of the block's own row, which comes last
            ends = np.concatenate((first, first[-1:]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(terms + 1, number, np.int64)),
                    pa.concat_arrays([coded.dictionary, pa.nulls(1, coded.dictionary.type)]),
                    lists(pa.array(place), ends), lists(pa.array(tf), ends),
                    pa.array(np.append(n, 0).astype(np.int32)), pa.array(np.append(edge(np.maximum, tf), 0).astype(np.int32)), pa.array(np.append(edge(np.minimum, dl[place]), 0).astype(np.int32)),
                    lists(b.column(0), own), lists(pa.array(dl), own), lists(b.column(3), own),
                ],
                ["block", "term", "place", "tf", "n", "most_tf", "least_dl", "ids", "dl", "tie"],
            )
            number += 1

    schema = f"block long, term string, place array<int>, tf array<int>, n int, most_tf int, least_dl int, ids array<{id_type}>, dl array<int>, tie array<long>"
    return rows.mapInArrow(run, schema)


def vocabulary(index: DataFrame) -> DataFrame:
    return index.filter("term is not null").select("term").distinct()


def collection(index: DataFrame) -> tuple[int, float]:
    """(documents that have terms, their mean length)."""
    got = index.filter("term is null").agg(F.sum(F.size(F.filter("dl", lambda x: x > 0))).alias("n"), F.sum(F.aggregate("dl", F.lit(0).cast("long"), lambda a, x: a + x)).alias("dl")).first()
    return (got["n"], got["dl"] / got["n"]) if got["n"] else (0, 0.0)


@dataclass
class _Lists:
    """The lists of one block, end to end, and which of them a query term asks for, with what weight."""

    place: np.ndarray
    tf: np.ndarray
    first: np.ndarray
    size: np.ndarray
    of: dict[str, tuple[np.ndarray, np.ndarray]]
    bound: dict[str, float]

    def postings(self, q: str) -> tuple[np.ndarray, np.ndarray]:
        """(where the postings of a query term's lists stand, the weight of each)."""
        lists, weights = self.of[q]
        size = self.size[lists]
        at = np.arange(int(size.sum())) + np.repeat(self.first[lists] - (np.cumsum(size) - size), size)
        return at, np.repeat(weights, size)


class _Block:
    """One block's documents, and its lists of the asked terms."""

    def __init__(self, ids: np.ndarray, tie: np.ndarray, norm: np.ndarray, lists: _Lists, p: Bm25):
        self.n, self.norm, self.lists, self.p = len(ids), norm, lists, p
        self.kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.held = 0
        self.scored = 0
        #: By tie and id: what comes first among equal scores.
        self.order = np.empty(self.n, np.int64)
        self.order[np.lexsort((ids, tie))] = np.arange(self.n)

    def _impact(self, w: np.ndarray, place: np.ndarray, tf: np.ndarray) -> np.ndarray:
        self.scored += len(place)
        return w * (self.p.delta + tf * (self.p.k1 + 1) / (tf + self.norm[place]))

    def _summed(self, place: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total, seen = np.bincount(place, s, self.n), np.bincount(place, minlength=self.n)
        at = np.flatnonzero(seen)
        return at.astype(np.int32), total[at]

    def whole(self, q: str) -> tuple[np.ndarray, np.ndarray]:
        """(documents, what the query term gives them): computed once for the queries that have the term, while it is kept; what was asked for longest ago goes first."""
        got = self.kept.pop(q, None)
        if got is None:
            at, w = self.lists.postings(q)
            place = self.lists.place[at]
            got = self._summed(place, self._impact(w, place, self.lists.tf[at]))
            self.held += got[0].nbytes + got[1].nbytes
        self.kept[q] = got
        while self.held > KEPT and len(self.kept) > 1:
            old = self.kept.pop(next(iter(self.kept)))
            self.held -= old[0].nbytes + old[1].nbytes
        return got

    def some(self, q: str, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for the documents that ``wanted`` marks alone: no other posting is scored."""
        got = self.kept.get(q)
        if got is not None:
            inside = wanted[got[0]]
            return got[0][inside], got[1][inside]
        at, w = self.lists.postings(q)
        place = self.lists.place[at]
        inside = wanted[place]
        place = place[inside]
        return self._summed(place, self._impact(w[inside], place, self.lists.tf[at[inside]]))

    def best(self, terms: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, scores, terms matched) of the k best of the block, by MaxScore.

        Terms come by what they can add at most. Once the terms to come can't lift
        a document that has none of the terms before them above the k-th best so
        far, only the documents found are looked up in their lists; those that
        can't reach the k-th best any more are left out on the way. A sum counts
        as often as it has terms, and so do the bounds. That order is the block's
        own, so whoever may be among the best is summed up again by term: equal
        documents have the same score to the last bit, whatever block holds them.
        """
        bound = self.lists.bound
        terms = sorted((t for t in terms if t in bound), key=lambda t: (-bound[t], t))
        acc, count = np.zeros(self.n), np.zeros(self.n, np.int32)
        rest = np.concatenate((np.cumsum([bound[t] for t in terms][::-1])[::-1], [0.0]))
        among: np.ndarray | None = None
        wanted = np.zeros(self.n, bool)
        given: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for i, t in enumerate(terms):
            place, s = given[t] = self.whole(t) if among is None else self.some(t, wanted)
            acc[place] += s
            count[place] += 1
            left = len(terms) - i - 1
            if not left or (among is None and i % 4 != 3):
                continue
            pool = np.flatnonzero(count) if among is None else among
            now = acc[pool] * count[pool]
            if len(pool) <= k:
                continue
            least = np.partition(now, len(now) - k)[len(now) - k] * (1 - 1e-9) - 1e-6
            if among is None and rest[i + 1] * left >= least:
                continue
            keep = (acc[pool] + rest[i + 1]) * (count[pool] + left) >= least
            among = pool[keep]
            wanted[:] = False
            wanted[among] = True
        pool = np.flatnonzero(count) if among is None else among
        if len(pool) > k:
            now = acc[pool] * count[pool]
            pool = pool[now >= np.partition(now, len(now) - k)[len(now) - k] * (1 - 1e-9) - 1e-6]
        total = np.zeros(len(pool))
        for t in sorted(given):
            place, s = given[t]
            at = np.searchsorted(place, pool)
            has = np.flatnonzero(at < len(place))
            has = has[place[at[has]] == pool[has]]
            total[has] += s[at[has]]
        score = np.floor(total * count[pool] * 1e9 + 0.5) / 1e9
        return self._first(pool, score, count, k)

    def matches(self, terms: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k documents that hold the most of the terms."""
        count = np.zeros(self.n, np.int32)
        for t in terms:
            if t in self.lists.of:
                place = np.unique(self.lists.place[self.lists.postings(t)[0]])
                self.scored += len(place)
                count[place] += 1
        pool = np.flatnonzero(count)
        return self._first(pool, count[pool].astype(np.float64), count, k)

    def _first(self, pool: np.ndarray, score: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(pool) > k:
            enough = score >= np.partition(score, len(score) - k)[len(score) - k]
            pool, score = pool[enough], score[enough]
        at = np.lexsort((self.order[pool], -score))[:k]
        return pool[at], score[at], count[pool[at]]


def _impact_bound(p: Bm25, avgdl: float):
    tf = F.col("most_tf")
    return p.delta + tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * F.col("least_dl") / F.lit(avgdl)))


def _lists_of(t: pa.Table) -> _Lists:
    t = t.combine_chunks()
    flat = lambda c: (lambda a: (a.offsets.to_numpy().astype(np.int64), a.values))(t.column(c).chunk(0))
    (at, place), (_, tf), (uses_at, uses) = flat("place"), flat("tf"), flat("for")
    base = at[0]
    one = lambda x: x.to_numpy(zero_copy_only=False)
    q = uses.field("q").slice(uses_at[0], uses_at[-1] - uses_at[0]).dictionary_encode()
    w = one(uses.field("w"))[uses_at[0] : uses_at[-1]]
    code, owner = one(q.indices), np.repeat(np.arange(len(uses_at) - 1), np.diff(uses_at))
    limit = np.bincount(code, w * one(t.column("bound").chunk(0))[owner], len(q.dictionary))
    # a query term's lists by their terms: sums then don't depend on the order in which a shuffle brought them
    rank = np.empty(t.num_rows, np.int64)
    rank[one(pc.sort_indices(t.column("term")))] = np.arange(t.num_rows)
    by = np.lexsort((rank[owner], code))
    ends = np.cumsum(np.bincount(code, minlength=len(q.dictionary)))
    names = q.dictionary.to_pylist()
    of = dict(zip(names, zip(np.split(owner[by], ends[:-1]), np.split(w[by], ends[:-1]), strict=True), strict=True)) if names else {}
    return _Lists(one(place)[base : at[-1]], one(tf)[base : at[-1]], at[:-1] - base, np.diff(at), of, dict(zip(names, limit.tolist(), strict=True)))


def search(index: DataFrame, terms: DataFrame, k: int, prefixes: bool = True, p: Bm25 = Bm25(), by: str = "score", tied: bool = False, queries: int = QUERIES, counted: bool = False) -> DataFrame:
    """(qid, doc_id, score, matched, rank): the best k documents of each query of ``terms`` (qid, q: distinct).

    ``by="score"``: BM25+ of the query's terms, with ``prefixes`` those of all
    longer terms that begin with one, times the query terms matched, to nine
    decimals. ``by="matched"``: the query terms that a document has. Ties fall
    by id, with ``tied`` by the index's ``tie`` before. Queries are answered ``queries`` at a
    time; a pass reads the lists of its terms alone. With ``counted``
    (block, scored, asked) instead: the postings that were scored, and those in
    the lists of all queries.
    """
    spark = index.sparkSession
    ship(spark)
    n_docs, avgdl = collection(index)
    id_type = index.schema["ids"].dataType.elementType.simpleString()
    by_query = terms.groupBy("qid").agg(F.sort_array(F.collect_set("q")).alias("terms"))
    qid_type = terms.schema["qid"].dataType.simpleString()
    out_schema = "block long, scored long, asked long" if counted else f"qid {qid_type}, doc_id {id_type}, score double, matched int, tie long"
    found, batch = None, []
    lists = index.filter("term is not null").select("block", "term", "place", "tf", "n", "most_tf", "least_dl")
    stats = lists.groupBy("term").agg(F.sum("n").alias("df"))

    def answer(asked: list) -> DataFrame:
        names, wants = [r["qid"] for r in asked], [list(r["terms"]) for r in asked]
        some = spark.createDataFrame([(0, t) for t in sorted({t for w in wants for t in w})], "qid int, q string")
        pairs = lexical.expand_prefixes(stats, some, p, "df") if prefixes else some.join(stats.withColumn("q", F.col("term")), "q").withColumn("weight", F.lit(1.0))
        idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
        # a list that several query terms ask for goes along once
        by_list = pairs.groupBy("term").agg(F.collect_list(F.struct("q", (F.col("weight") * idf).alias("w"))).alias("for"))
        got = lists.join(by_list, "term").select("block", "term", "place", "tf", "for", _impact_bound(p, avgdl).alias("bound"))
        # empty rather than null lists: Arrow's writer goes over a run of null lists again for each of them
        no = lambda kind, name: F.array().cast(f"array<{kind}>").alias(name)
        own = index.filter("term is null").select("block", "term", no("int", "place"), no("int", "tf"), no("struct<q:string,w:double>", "for"), F.lit(None).cast("double").alias("bound"), "ids", "dl", "tie")
        both = got.select("block", "term", "place", "tf", "for", "bound", no(id_type, "ids"), no("int", "dl"), no("long", "tie")).unionByName(own)

        def run(t: pa.Table) -> pa.Table:
            head = t.column("bound").is_null().index(True).as_py()
            ids, dl, tie = (t.column(c)[head].values for c in ("ids", "dl", "tie"))
            tie = tie if tied else pa.array(np.zeros(len(tie), np.int64))
            norm = p.k1 * (1 - p.b + p.b * dl.to_numpy() / avgdl) if avgdl else np.ones(len(dl))
            block = _Block(ids.to_numpy(zero_copy_only=False), tie.to_numpy(), norm, _lists_of(t), p)
            rows = [(block.best if by == "score" else block.matches)(w, k) for w in wants]
            if counted:
                size = {q: int(block.lists.size[x].sum()) for q, (x, _) in block.lists.of.items()}
                asked_for = sum(size.get(q, 0) for w in wants for q in w)
                return pa.table({"block": [t.column("block")[0].as_py()], "scored": [block.scored], "asked": [asked_for]})
            sizes = [len(x) for x, _, _ in rows]
            pool = np.concatenate([x for x, _, _ in rows])
            return pa.table(
                {
                    "qid": pa.array(names).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), "doc_id": ids.take(pa.array(pool, pa.int64())), "score": np.concatenate([s for _, s, _ in rows]),
                    "matched": np.concatenate([c for _, _, c in rows]).astype(np.int32), "tie": tie.take(pa.array(pool, pa.int64())),
                }
            )

        # a number of its own, as blocks cost far more than their bytes tell: adaptive execution would put them into few tasks
        n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
        return both.repartition(n, "block").groupBy("block").applyInArrow(run, out_schema)

    for r in by_query.toLocalIterator():
        batch.append(r)
        if len(batch) == queries:
            more, batch = answer(batch), []
            found = more if found is None else found.unionByName(more)
    if batch:
        found = answer(batch) if found is None else found.unionByName(answer(batch))
    if found is None:
        found = spark.createDataFrame([], out_schema)
    if counted:
        return found
    order = [F.desc("score"), "tie", "doc_id"]
    return lexical.first_k(found, k, order).drop("tie")
