"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 that follows from its code point
alone. A trigram's vector binds its letters: the first letter's vector permuted
(rolled) twice, the second's once, the third's as it is, multiplied. A text is
the sum (bundle) of its trigrams' vectors, a language the sum of its texts;
a text gets the language whose prototype has the greatest cosine with it.

Trigrams lie within words: what isn't a letter stands for one border symbol, and
each letter is the middle of one trigram. All sums are of whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import give_back, ship, spread

#: Numbers of a vector; a text's cosine with another language's prototype strays by about 1 / sqrt(DIMS).
DIMS = 1024
SEED = 20_240_611
#: Languages that a model may hold: the prototypes go to every task.
MOST_LANGUAGES = 4096
UNKNOWN = "und"
#: Characters and texts of one step, trigrams of one product: they bound a task's memory, not what is read.
STEP_CHARS, STEP_TEXTS, STEP_GRAMS = 1 << 20, 512, 8192
_BITS = 21


@dataclass(frozen=True)
class Profiles:
    """``prototypes`` has a row of DIMS whole numbers for each of ``languages`` (ascending)."""

    languages: list[str]
    prototypes: np.ndarray


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter's code point, 0 (the border) where it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


@lru_cache(maxsize=50_000)
def _letter(code: int) -> np.ndarray:
    return (np.random.default_rng([SEED, code]).integers(0, 2, DIMS, np.int8) * 2 - 1).astype(np.int8)


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """The vectors of packed trigrams, a row each."""
    mask = (1 << _BITS) - 1
    out = np.ones((len(grams), DIMS), np.int8)
    for shift in (2, 1, 0):
        codes, at = np.unique(grams >> (_BITS * shift) & mask, return_inverse=True)
        table = np.stack([np.roll(_letter(int(c)), shift) for c in codes]) if len(codes) else np.zeros((0, DIMS), np.int8)
        out *= table[at]
    return out


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of texts, their packed trigrams), step by step; a long text comes in several steps."""
    chunks: list[str] = []
    owner: list[int] = []
    cut: list[tuple[bool, bool]] = []
    held = 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        code = np.frombuffer(("\n" + "\n".join(chunks) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        s = _letters()[code].astype(np.int64)
        first = 1 + np.cumsum(sizes + 1) - (sizes + 1)
        at = spread(first, sizes)
        middle = s[at] != 0
        for k, (head, tail) in enumerate(cut):
            begin = int(sizes[:k].sum()) if head or tail else 0
            if head:
                middle[begin] = False  # the middle of the piece before
            if tail:
                middle[begin + int(sizes[k]) - 1] = False
        who = np.repeat(np.asarray(owner, np.int64), sizes)[middle]
        at = at[middle]
        return who, (s[at - 1] << (2 * _BITS)) | (s[at] << _BITS) | s[at + 1]

    for i, t in enumerate(texts):
        n = len(t or "")
        for lo in range(0, n, STEP_CHARS):
            hi = min(n, lo + STEP_CHARS)
            piece = t if hi - lo == n else t[max(0, lo - 1) : hi + 1]
            if chunks and (held + len(piece) > STEP_CHARS or len(chunks) >= STEP_TEXTS):
                yield flush()
                chunks, owner, cut, held = [], [], [], 0
            chunks.append(piece)
            owner.append(i)
            cut.append((lo > 0, hi < n))
            held += len(piece)
    if chunks:
        yield flush()


def bundles(texts: list[str | None], groups: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the trigram vectors of each of ``n`` groups of texts, trigrams of each)."""
    out, count = np.zeros((n, DIMS), np.float64), np.zeros(n, np.int64)
    for who, grams in _pieces(texts):
        coded = pa.array(grams).dictionary_encode()
        at, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False)
        rows, row = np.unique(groups[who], return_inverse=True)
        count += np.bincount(groups[who], minlength=n)
        for lo in range(0, len(names), STEP_GRAMS):
            part = names[lo : lo + STEP_GRAMS]
            inside = (at >= lo) & (at < lo + len(part)) if len(names) > STEP_GRAMS else slice(None)
            counts = np.bincount(row[inside] * len(part) + at[inside] - lo, minlength=len(rows) * len(part)).reshape(len(rows), len(part))
            out[rows] += counts.astype(np.float32) @ gram_vectors(part).astype(np.float32)
    return out, count


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn: Column | None = None) -> Profiles:
    """Prototypes from all rows with a text and a language that ``learn`` keeps (all of them without it).

    Nothing is sampled. A task sends one row for each of its languages and
    numbers of a vector, which are summed before the driver gets one vector a
    language. Null languages, null and empty texts and texts without letters
    teach nothing; repeated rows count each; columns of other names are not
    looked at, whatever they are called; very long texts are read whole, piece
    by piece. An empty table gives no languages. More than MOST_LANGUAGES
    languages are an error, as the prototypes go to every task.
    """
    spark = docs.sparkSession
    ship(spark)
    kept = docs if learn is None else docs.filter(learn)
    rows = kept.select(docs[text_col].cast("string").alias("t"), docs[lang_col].cast("string").alias("l")).filter("t is not null and l is not null")

    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in it:
            langs = b.column(1).dictionary_encode()
            names = langs.dictionary.to_pylist()
            got, count = bundles(b.column(0).to_pylist(), langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(names))
            for name, v, c in zip(names, got, count, strict=True):
                if c:
                    total[name] = total.get(name, 0) + v.astype(np.int64)
        give_back()
        if total:
            n = len(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(n), DIMS)).cast(pa.int32()), pa.array([k for k in total for _ in range(DIMS)], pa.string()), pa.array(np.tile(np.arange(DIMS, dtype=np.int32), n)), pa.array(np.concatenate(list(total.values())))],
                ["k", "l", "i", "v"],
            )

    sums = rows.mapInArrow(partial, "k int, l string, i int, v long").groupBy("l", "i").agg(F.sum("v").alias("v"))
    vectors = sums.groupBy("l").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("x")).select("l", F.col("x.v").alias("v")).limit(MOST_LANGUAGES + 1).collect()
    if len(vectors) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    vectors = sorted((r["l"], r["v"]) for r in vectors)
    return Profiles([x for x, _ in vectors], np.array([v for _, v in vectors], np.int64).reshape(len(vectors), DIMS))


def predict(docs: DataFrame, model: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (id, lang_pred, score) for each row: the language of the greatest cosine, and that cosine within 0 and 1.

    ``und`` and 0 where the text is null, empty or has no letter, and for all
    texts where the model has no languages; ties fall to the smaller name;
    repeated rows get the same answer, null ids are kept; very long texts are
    read whole, piece by piece; other columns are left out, so that their names
    can't clash; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    names, p = model.languages, model.prototypes.astype(np.float64)
    length = np.sqrt((p * p).sum(axis=1, keepdims=True))
    unit = np.divide(p, length, out=np.zeros_like(p), where=length > 0)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo in range(0, b.num_rows, STEP_TEXTS):
                part = b.slice(lo, STEP_TEXTS)
                v, count = bundles(part.column(1).to_pylist(), np.arange(part.num_rows), part.num_rows)
                size = np.sqrt((v * v).sum(axis=1))
                known = (count > 0) & (size > 0) & bool(names)
                best, score = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows)
                if names:
                    cos = np.round((v @ unit.T) / np.where(size > 0, size, 1)[:, None], 9)
                    best = cos.argmax(axis=1)
                    score = np.where(known, np.clip(cos[np.arange(len(cos)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([names[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)], pa.string()), pa.array(score)], ["id", "lang_pred", "score"])
        give_back()

    ids = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return ids.mapInArrow(run, f"id {ids.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)
