"""op2: fingerprints of the documents, of edited texts, and their likeness."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skerry.llm.common import batches_of, read_table, ship, strings
from skerry.llm.fingerprint import BATCH_BYTES, containment, digest_sets, to_text, with_successors

OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None  # the row whose successor hasn't come yet: id, text, fingerprint

    for b in batches_of(it, "text", BATCH_BYTES):
        ids, texts, ahead = b.column(0).to_pylist(), strings(b.column(1)), b.column(2).to_pylist()
        fps = digest_sets([t.encode("utf-8", "surrogatepass") for t in texts])
        firsts, nexts = [], []
        for row in zip(ids, texts, fps, ahead, strict=True):
            if last is not None:
                firsts.append(last)
                nexts.append(row)
            last = None if row[3] else row
        edited = [t[: len(t) - len(t) // 2] + nxt[1][: len(t) // 2] for (_, t, _, _), nxt in zip(firsts, nexts, strict=True)]
        raw = [t.encode("utf-8", "surrogatepass") for t in edited]
        efps = digest_sets(raw)
        if firsts:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in firsts], pa.int64()),
                    pa.array([len(r[1]) for r in firsts], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
                    pa.array([to_text(r[2]) for r in firsts], pa.string()),
                    pa.array([to_text(x) for x in efps], pa.string()),
                    pa.array([containment(r[2], e) for r, e in zip(firsts, efps, strict=True)], pa.float64()),
                    pa.array([containment(r[2], n[2]) for r, n in zip(firsts, nexts, strict=True)], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return with_successors(read_table(spark, sf_dir, "documents")).mapInArrow(_compare, OUT)
