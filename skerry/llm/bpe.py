"""BPE encoding and decoding through a distinct-word table.

Documents are cut into blocks; each block holds its distinct words once and a
code stream of positions. The words of all blocks meet in the distinct-word
table, dealt by hash, where every distinct word is encoded once (a part of more
than REMEMBERED distinct words begins anew), and their ids join back to the
blocks by position, where each distinct word takes its ids' pieces once. Stored
ids are decoded by ``decode``, a join with the vocabulary.

Words are read twice (once for the table, once for the streams) rather than
stored, so the input must give the same rows when it is read again, as files
and checkpoints do; a block whose words don't come back complete raises.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import batches_of, give_back, n_parts, ship, spread, strings
from skerry.llm.words import WordBpe, word_bpe

#: Bytes of text that one block holds; a longer text is a block of its own.
BLOCK_BYTES = 3_000_000
#: Distinct words whose ids a part of the table holds at once, about 200 bytes each.
REMEMBERED = 1_000_000

Project = Callable[[list[int | None], list[np.ndarray], list[list[str]]], dict[str, list]]


def _blocks(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, list[str]]]:
    """(key, ids, texts) of each block; the key is a hash of what the block holds."""
    for b in batches_of(it, "text", BLOCK_BYTES):
        texts = strings(b.column(1))
        h = xxhash.xxh64(seed=7)
        for i, t in zip(b.column(0).to_pylist(), texts, strict=True):
            raw = t.encode("utf-8", "surrogatepass")
            h.update(f"{i},{len(raw)};".encode())
            h.update(raw)
        yield int(np.uint64(h.intdigest()).astype(np.int64)), b.column(0), texts


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(values.tobytes())


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _words_of(path: str, buckets: int):
    """One row for each block and bucket of the table: the bucket's words and their places in the block."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, zip_ = word_bpe(path), zstandard.ZstdCompressor(level=3)
        for key, _, texts in _blocks(it):
            words = [w.encode() for w in bpe.split(texts)[0].to_pylist()]
            if not words:
                continue
            bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            rows = []
            for own in np.split(order, cuts):
                joined = b"\n".join([words[i] for i in own])
                rows.append((int(bucket[own[0]]), key, _pack(np.diff(own, prepend=0).astype("<u4")), zip_.compress(joined)))
            give_back()
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "block", "at", "words"]
            )

    return run


def _streams_of(path: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, zip_ = word_bpe(path), zstandard.ZstdCompressor(level=3)
        for key, ids, texts in _blocks(it):
            words, codes, head, count = bpe.split(texts)
            codes = codes[spread(head, count)]
            give_back()
            packed = np.concatenate(((codes & 0xFFFF).astype(np.uint16), (codes >> 16).astype(np.uint16))).tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([key]),
                    pa.array([len(words)], pa.int32()),
                    pa.array([ids.to_pylist()], pa.list_(pa.int64())),
                    pa.array([count.tolist()], pa.list_(pa.int32())),
                    pa.array([zip_.compress(packed)], pa.binary()),
                ],
                ["block", "n_words", "ids", "counts", "codes"],
            )

    return run


def _encode_table(path: str):
    """A bucket holds all occurrences of its words: each distinct word is encoded once, or once in every REMEMBERED."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe: WordBpe = word_bpe(path)
        known: dict[bytes, int] = {}
        parts: list[bytes] = []
        for b in it:
            for block, at, packed in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                words = zstandard.ZstdDecompressor().decompress(packed).split(b"\n")
                if len(known) > REMEMBERED:
                    known.clear()
                    parts.clear()
                new = [w for w in words if w not in known]
                if new:
                    known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                    ids, lens = bpe.encode([w.decode() for w in new])
                    raw = ids.astype("<u4").tobytes()
                    ends = (np.cumsum(lens) * 4).tolist()
                    parts += [raw[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)]
                got = [parts[known[w]] for w in words]
                ids = np.frombuffer(b"".join(got), "<u4")
                lens = np.fromiter(map(len, got), np.int64, len(got)) // 4
                small = np.concatenate((ids & 0xFFFF, ids >> 16)).astype("<u2")
                yield pa.RecordBatch.from_pydict({"block": [block], "at": [at], "lens": [_pack(lens.astype("<u4"))], "ids": [_pack(small)]})

    return run


def _real(ids: list, tokens: list[np.ndarray], pieces: list[list[str]]) -> dict[str, list]:
    return {"doc_id": ids, "ids": tokens, "decoded": [" ".join(p) for p in pieces]}


def _join_back(path: str, project: Project, schema: pa.Schema):
    def run(words: pa.Table, streams: pa.Table) -> pa.Table:
        bpe = word_bpe(path)
        got = words.to_pylist()
        at = np.concatenate([np.cumsum(_unpack(w["at"], "<u4").astype(np.int64)) for w in got]) if got else np.zeros(0, np.int64)
        got_lens = np.concatenate([_unpack(w["lens"], "<u4").astype(np.int64) for w in got]) if got else np.zeros(0, np.int64)
        halves = [_unpack(w["ids"], "<u2").astype(np.uint32).reshape(2, -1) for w in got]
        tab_ids = np.concatenate([h[0] | (h[1] << np.uint32(16)) for h in halves]) if got else np.zeros(0, np.uint32)
        got_starts = np.cumsum(got_lens) - got_lens
        out = []
        for s in streams.to_pylist():
            place = np.full(s["n_words"], -1, np.int64)
            if s["n_words"]:
                place[at] = np.arange(len(at))
            if (place < 0).any():
                raise ValueError("a block's words came back incomplete: the input changed between two readings")
            starts, lens = got_starts[place], got_lens[place]
            flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(s["codes"]), np.uint16)
            codes = flat[: len(flat) // 2].astype(np.int32) | (flat[len(flat) // 2 :].astype(np.int32) << 16)
            texts = np.empty(len(starts), object)
            texts[:] = [bpe.pieces[own[0]] if len(own) == 1 else " ".join([bpe.pieces[i] for i in own]) for own in (tab_ids[a : a + n].tolist() for a, n in zip(starts.tolist(), lens.tolist(), strict=True))]
            tokens, pieces, at_word = [], [], 0
            for n in s["counts"]:
                own = codes[at_word : at_word + n]
                tokens.append(tab_ids[spread(starts[own], lens[own])])
                pieces.append(texts[own].tolist())
                at_word += n
            out.append(pa.Table.from_pydict(project(s["ids"], tokens, pieces), schema=schema))
        give_back()
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


REAL_SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def encode_decode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", project: Project = _real, schema: pa.Schema = REAL_SCHEMA
) -> DataFrame:
    """One row per document: ``doc_id``, ``ids array<int>``, ``decoded string``.

    Equals the tokenizers library's ``encode(text, add_special_tokens=False)``
    and ``decode(ids, skip_special_tokens=False)`` with the file at ``path``,
    truncation and padding unused. ``project`` turns ids and pieces into other
    columns within the same pass; a word's pieces come as one string, joined by
    spaces as decoding does. A null text counts as empty (no ids, decoded
    to ''); null ids, repeated rows and repeated ids each give a row; other
    columns of ``docs`` are left out, so their names can't clash; an empty
    table gives an empty one. A very long text is a block of its own.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    buckets = n_parts(spark)
    words = rows.mapInArrow(_words_of(path, buckets), "bucket int, block long, at binary, words binary")
    table = words.repartitionById(buckets, F.col("bucket")).mapInArrow(_encode_table(path), "block long, at binary, lens binary, ids binary")
    streams = rows.mapInArrow(_streams_of(path), "block long, n_words int, ids array<long>, counts array<int>, codes binary")
    from pyspark.sql.pandas.types import from_arrow_schema

    return table.groupBy("block").cogroup(streams.groupBy("block")).applyInArrow(_join_back(path, project, schema), from_arrow_schema(schema))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece) of the tokenizer file: as many rows as it has ids."""
    pieces = word_bpe(path).pieces
    return spark.createDataFrame(pa.table({"id": pa.array(range(len(pieces)), pa.int32()), "piece": pa.array(pieces, pa.string())}))


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and ``decoded`` of every row of stored ids: each id joins its piece, pieces join by spaces in order.

    Null or empty ids decode to ''; ids that the file doesn't have are left
    out; null and repeated document ids give a row each; other columns are left
    out, whatever their names; an empty table gives an empty one. The
    vocabulary is broadcast: it is as large as the file, whatever the corpus.
    """
    rows = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("_ids")).withColumn("_row", F.monotonically_increasing_id())
    each = rows.select("_row", "doc_id", F.posexplode_outer("_ids").alias("_at", "id")).join(F.broadcast(vocabulary(tokens.sparkSession, path)), "id", "left")
    pieces = F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("_at", "piece"))))
    return each.groupBy("_row", "doc_id").agg(F.array_join(F.transform(pieces, lambda x: x["piece"]), " ").alias("decoded")).select("doc_id", "decoded")
