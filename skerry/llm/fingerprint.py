"""Document fingerprints by content-defined chunking.

A gear hash over a sliding window of 32 bytes sets chunk boundaries, normalised
by a strict mask below the usual chunk size and a loose one above it. Chunks
move with their content, so an insertion changes only the chunks it touches. A
fingerprint is the set of chunk digests with the bytes that each stands for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import batches_of, by_id_order, ship, strings

LEAST, USUAL, MOST = 16, 64, 256
STRICT_BITS, LOOSE_BITS = 8, 4
#: Stands between texts in a buffer, so that a window never reaches into another text.
GAP = bytes(32)
BATCH_BYTES = 2_000_000

#: One 32-bit value for each byte, by rule: XXH32 of the byte.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 17) for b in range(256)], np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash (h = 2h + gear[byte], 32 bits) at every byte, by doubling."""
    h = GEAR[data]
    for s in (1, 2, 4, 8, 16):
        if len(h) > s:
            more = h[:-s] << np.uint32(s)
            h[s:] += more
    return h


def chunk_ends(sizes: list[int], data: bytes) -> list[list[int]]:
    """For each of the texts that ``data`` holds, each after a ``GAP``, the ends of its chunks."""
    h = gear_hashes(np.frombuffer(data, np.uint8))
    loose = np.flatnonzero(h < np.uint32(1 << (32 - LOOSE_BITS)))
    strict = (h[loose] < np.uint32(1 << (32 - STRICT_BITS))).tolist()
    spots = (loose + 1).tolist()
    spots.append(len(data) + MOST + 1)
    strict.append(True)
    out, i, begin = [], 0, len(GAP)
    for size in sizes:
        stop, start, ends = begin + size, begin, []
        while spots[i] <= begin:
            i += 1
        while start < stop:
            p = spots[i]
            if p >= stop and stop - start <= MOST:
                ends.append(stop)
                break
            n = p - start
            if n > MOST:
                start += MOST
                ends.append(start)
                continue
            if n >= USUAL or n >= LEAST and strict[i]:
                ends.append(p)
                start = p
            i += 1
        out.append(ends)
        begin = stop + len(GAP)
    return out


def digest_sets(texts: list[bytes]) -> list[dict[int, int]]:
    """Each text's chunk digests with the bytes they stand for."""
    data = GAP + GAP.join(texts)
    digest = xxhash.xxh3_64_intdigest
    out, begin = [], len(GAP)
    for text, ends in zip(texts, chunk_ends([len(t) for t in texts], data), strict=True):
        got: dict[int, int] = {}
        at = begin
        for z in ends:
            d = digest(data[at:z])
            got[d] = got.get(d, 0) + z - at
            at = z
        begin += len(text) + len(GAP)
        out.append(got)
    return out


def to_text(fp: dict[int, int]) -> str:
    return ",".join([f"{d:016x}:{n:x}" for d, n in sorted(fp.items())])


def from_text(text: str) -> dict[int, int]:
    return {int(d, 16): int(n, 16) for d, n in (x.split(":") for x in text.split(","))} if text else {}


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """The share of the shorter text's bytes whose chunks the other has too; two empty texts: 1."""
    if not a or not b:
        return float(not a and not b)
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    both = sum([min(n, large[d]) for d, n in small.items() if d in large])
    return both / min(sum(a.values()), sum(b.values()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fingerprint`` of every whole text; a null text is empty, an empty text's fingerprint is ''.

    Repeated rows, null ids and extra columns are no matter: one row comes out
    for each row, and equal texts have equal fingerprints.
    """
    ship(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it, "text", BATCH_BYTES):
            got = digest_sets([t.encode("utf-8", "surrogatepass") for t in strings(b.column(1))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([to_text(x) for x in got], pa.string())], ["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def with_successors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, _ahead) so that each row's successor in id order follows it in its partition.

    Rows with ``_ahead`` above 0 only end the row before them. Null ids come
    first, repeated ids are ordered by their text, the last row's successor is
    the first row.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return by_id_order(rows, "id", ahead=True).sortWithinPartitions(F.col("_ahead") == 2, F.col("id").asc_nulls_first(), F.col("text")).select("id", "text", "_ahead")
