"""A quality classifier over random-indexing word vectors.

A word's index vector is a sparse vector of +1 and -1 by hash; its context
vector is the sum of the index vectors of the words around it. Context vectors
are kept for hashed words, a table of fixed size, summed over the labelled
sample. A document pools both over all its words, punctuation runs and word
shapes, and a two-layer numpy network with a temperature fitted on held-back
rows turns that into a probability.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import batches_of, cut, give_back, numbered, place, ship, spread, strings

#: Rows that the classifier is fitted on at most (all labelled rows up to that; beyond, those of the smallest hashes).
SAMPLE_ROWS = 20_000
#: Tasks over the sample; each makes one table of context sums (3 MB).
SAMPLE_PARTS = 12
BUCKETS, DIM, NONZERO, REACH = 1 << 14, 48, 4, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 20, 256, 2e-3, 1e-3
BATCH_BYTES = 1_000_000
#: Words of the sample's average that a text's own words are weighed against.
PRIOR_WORDS = 4
#: Runs of which a worker remembers the hashes, and their length at most.
REMEMBERED, REMEMBERED_CHARS = 100_000, 64

#: A word: letters and digits, or one character of a script that writes words without spaces.
_CORE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]|[^\W_\u3040-\u30ff\u3400-\u9fff]+(?:['’-][^\W_\u3040-\u30ff\u3400-\u9fff]+)*")
_REPEAT = "\1again"


def bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS


@lru_cache(maxsize=1)
def index_vectors() -> np.ndarray:
    """By rule: the places and signs of bucket b come from a generator seeded with one number."""
    rng = np.random.default_rng(20_011)
    out = np.zeros((BUCKETS, DIM), np.float32)
    for _ in range(NONZERO):
        np.add.at(out, (np.arange(BUCKETS), rng.integers(0, DIM, BUCKETS)), rng.choice((-1.0, 1.0), BUCKETS).astype(np.float32))
    return out


UPPER, MIXED, TITLE, MARKS = (bucket("\1" + x) for x in ("upper", "mixed", "title", "marks"))


def _shape(core: str) -> int:
    if core.islower() and core.isalpha():
        return -1
    if len(core) > 1 and core.isupper():
        return UPPER
    if not core.isalpha():
        return MIXED
    return TITLE if core[0].isupper() else -1


@lru_cache(maxsize=10_000)
def _few_marks(marks: str) -> int:
    return bucket("\2" + marks)


def _marks(marks: str) -> int:
    return -1 if not marks else _few_marks(marks) if len(marks) <= 8 else bucket("\2" + marks)


def parts_of(chunk: str) -> list[tuple[int, int, int]]:
    """Hashed word, marks and shape for each word of a run of non-space characters, whole; -1 stands for none.

    A word has the marks up to the next one, the first also those before it.
    """
    if chunk.isalpha() and chunk.isascii():
        return [(bucket(chunk.lower()), -1, _shape(chunk))]
    m = _CORE.search(chunk)
    if not m:
        return [(-1, _marks(chunk), MARKS)]
    out, ahead = [], chunk[: m.start()]
    while m:
        after = _CORE.search(chunk, m.end())
        marks = ahead + chunk[m.end() : after.start() if after else len(chunk)]
        out.append((bucket(m[0].lower()), _marks(marks), _shape(m[0])))
        ahead, m = "", after
    return out


_remembered = lru_cache(maxsize=REMEMBERED)(parts_of)


def chunks(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(parts of the distinct runs' words, words of each distinct run, codes of all runs, runs of each text)."""
    lists = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
    flat = lists.flatten()
    keep = pc.not_equal(flat, "")
    coded = pc.filter(flat, keep).dictionary_encode()
    kept = np.concatenate(([0], np.cumsum(keep.to_numpy(zero_copy_only=False), dtype=np.int64)))
    ends = kept[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    each = [_remembered(w) if len(w) <= REMEMBERED_CHARS else parts_of(w) for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
    n = np.fromiter(map(len, each), np.int64, len(each))
    parts = np.fromiter((x for ps in each for p in ps for x in p), np.int64, 3 * int(n.sum())).reshape(-1, 3)
    return parts, n, coded.indices.to_numpy(zero_copy_only=False), np.diff(ends)


def _rows(table: np.ndarray, which: np.ndarray) -> np.ndarray:
    got = table[np.maximum(which, 0)]
    got[which < 0] = 0
    return got


def pooled(texts: list[str], context: np.ndarray) -> np.ndarray:
    """Mean index and context vectors over a text's words, and the log of their number; zeros for an empty text."""
    parts, n, codes, counts = chunks(texts)
    out = np.zeros((len(texts), 2 * DIM + 1), np.float32)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    index = index_vectors()
    table = np.hstack([sum(_rows(t, parts[:, k]) for k in range(3)) for t in (index, context)])
    several = n > 1
    if several.any():  # a run of several words is their sum
        first = np.cumsum(n) - n
        sums = np.add.reduceat(table[np.repeat(several, n)], np.cumsum(n[several]) - n[several], axis=0)
        table = table[first]
        table[several] = sums
    begin = (np.cumsum(counts) - counts)[some]
    total = np.zeros((len(some), 2 * DIM), np.float64)
    step = 20_000  # runs gathered at a time
    for a in range(0, len(codes), step):
        z = min(len(codes), a + step)
        lo, hi = np.searchsorted(begin, a, side="right") - 1, np.searchsorted(begin, z, side="left")
        total[lo:hi] += np.add.reduceat(table[codes[a:z]], np.maximum(begin[lo:hi] - a, 0), axis=0)
    again = np.concatenate(([False], codes[1:] == codes[:-1]))
    again[begin] = False
    repeats = np.add.reduceat(again, begin, dtype=np.int64)
    words = np.add.reduceat(n[codes], begin)
    b = bucket(_REPEAT)
    total += repeats[:, None] * np.concatenate((index[b], context[b]))[None, :] * NONZERO
    out[some, :-1] = total / words[:, None]
    out[some, -1] = np.log1p(words)
    return out


def contexts(texts: list[str]) -> np.ndarray:
    """Sums of the index vectors of the words within REACH, for each hashed word of the texts."""
    parts, n, codes, counts = chunks(texts)
    out = np.zeros((BUCKETS, DIM), np.float32)
    if not len(codes):
        return out
    reps = n[codes]
    counts = np.diff(np.concatenate(([0], np.cumsum(reps)))[np.concatenate(([0], np.cumsum(counts)))])
    codes = spread((np.cumsum(n) - n)[codes], reps)
    index = index_vectors()
    table = sum(_rows(index, parts[:, k]) for k in range(3))
    doc = np.repeat(np.arange(len(counts)), counts)
    for d in range(1, REACH + 1):
        if len(codes) <= d:
            break
        same = doc[:-d] == doc[d:]
        left, right = codes[:-d][same], codes[d:][same]
        for a, b in ((left, right), (right, left)):
            for k in range(3):
                to = parts[a, k]
                ok = to >= 0
                np.add.at(out, to[ok], table[b[ok]])
        again = same & (codes[:-d] == codes[d:])
        if d == 1 and again.any():
            out[bucket(_REPEAT)] += table[codes[1:][again]].sum(axis=0)
    return out


@dataclass
class Model:
    context: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """Standardised; the fewer words a text has, the nearer its means are drawn to the sample's."""
        n = np.expm1(x[:, -1:])
        drawn = (x - self.mean) / self.scale
        drawn[:, :-1] *= n / (n + PRIOR_WORDS)
        return np.clip(drawn, -8, 8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(self.inputs(x) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, texts: list[str]) -> np.ndarray:
        z = self.logits(pooled(texts, self.context).astype(np.float64)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [np.mean(np.logaddexp(0, -np.where(y > 0, z, -z) / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(x: np.ndarray, y: np.ndarray, context: np.ndarray, seed: int = 11) -> Model:
    """Adam on log loss; a tenth of the rows is held back for the temperature.

    Without rows, or with rows of one label only, the score is that label's
    smoothed share for every text.
    """
    n, d = x.shape
    if not n or y.min() == y.max():
        p = (y.sum() + 1) / (n + 2)
        z = np.zeros
        return Model(context, z(d), np.ones(d), z((d, 1)), z(1), z(1), float(np.log(p / (1 - p))), 1.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    back, fit = order[: n // 10], order[n // 10 :]
    mean, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
    model = Model(context, mean, scale, np.zeros((d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0)
    xs = model.inputs(x)
    w = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(fit), max(1, len(fit) // BATCH)):
            h = xs[at] @ w[0] + w[1]
            a = np.maximum(h, 0)
            z = a @ w[2] + w[3][0]
            g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[at]) / len(at)
            gh = np.outer(g, w[2]) * (h > 0)
            grads = [xs[at].T @ gh + DECAY * w[0], gh.sum(axis=0), a.T @ g + DECAY * w[2], np.array([g.sum()])]
            t += 1
            for p, q, r, s in zip(w, grads, m, v, strict=True):
                r += 0.1 * (q - r)
                s += 0.001 * (q * q - s)
                p -= RATE * (r / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = w[0], w[1], w[2], float(w[3][0])
    if len(back):
        model.temperature = _temperature(model.logits(x[back]), y[back])
    return model


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """Fits on the labelled rows outside the held-out fold, SAMPLE_ROWS of them at most.

    Labels are the only thing taken from ``labels``; null ids or labels and
    labels other than 0 and 1 are passed over, of several labels of an id the
    smallest counts, of several texts the first in order. Null texts are empty,
    very long ones are read whole; without labels or documents the score is a
    half. The driver gets ``rows`` pooled vectors at most, never texts.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)").filter(~held_out("id"))
    known = cut(known.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    one = texts.join(F.broadcast(known), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    sample = cut(one.select("id", "text", "y").repartition(SAMPLE_PARTS, "id"))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, DIM), np.float32)
        for b in batches_of(it, "text", BATCH_BYTES):
            total += contexts(strings(b.column(1)))
        yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, DIM), np.float32)
        for b in it:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x, np.float32).reshape(BUCKETS, DIM)
        yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})

    # sums of whole numbers: exact in any order; one task adds the few tables, the driver gets one
    each = sample.select("id", "text").coalesce(SAMPLE_PARTS).mapInArrow(count, "sums binary")
    context = np.frombuffer(each.repartition(1).mapInArrow(add, "sums binary").first()["sums"], np.float32).reshape(BUCKETS, DIM)
    size = np.linalg.norm(context, axis=1, keepdims=True)
    context = (context / np.maximum(size, 1e-9)).astype(np.float32)

    def pool(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it, "text", BATCH_BYTES):
            x = pooled(strings(b.column(1)), context)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "y", "x"])

    got = sample.select("id", "text", "y").mapInArrow(pool, "id long, y int, x binary").collect()
    got.sort(key=lambda r: (r["id"], bytes(r["x"])))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in got], np.float64).reshape(len(got), 2 * DIM + 1)
    y = np.array([r["y"] for r in got], np.float64)
    del got
    model = train(x, y, context)
    del x
    give_back()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, higher: better) of every whole text; a null text counts as empty.

    A row for each row, repeated ones alike; null ids are kept; very long texts
    are read whole, words of any length too; other columns, whatever their
    names, are left out and no input of a score; an empty table gives an empty one.
    """
    ship(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it, "text", BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(strings(b.column(1))), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows whose text scores ``threshold`` or more, all columns as they are, whatever their names.

    Null and empty texts go by the empty text's score; a score of just the
    threshold stays; repeated rows go or stay alike; very long texts are read
    whole; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    plain, text = numbered(docs), place(docs, text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it, text, BATCH_BYTES):
            yield b.filter(pa.array(model.score(strings(b.column(text))) >= threshold))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
