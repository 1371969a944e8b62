"""Token ids in seekable binary files.

A file holds independent zstandard frames (each with zstd's own content
checksum) of little-endian ids of whole documents, a skippable frame with the
document index, and a trailing seek table in the public seekable-zstd layout:
per frame its compressed size, its raw size and the low 32 bits of the XXH64 of
its raw bytes. A reader takes the table from the file's end and decompresses
only the frames of the documents asked for.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import batches_of, by_id_order, filesystem, give_back, new_dir, ship, spread, strings
from skerry.llm.words import word_bpe

FRAME_IDS = 262_144
#: Ids, and documents, of a file from which the next batch of its range begins another; they bound its index in memory.
FILE_IDS, FILE_DOCS = 1 << 28, 1 << 20
BATCH_BYTES = 3_000_000
#: Words whose ids a worker remembers at most, before it begins anew.
REMEMBERED = 700_000

#: Fixed values of the seekable format.
SEEK_MAGIC, SKIP_INDEX, SKIP_TABLE, HAS_CHECKSUMS = 0x8F92EAB1, 0x184D2A50, 0x184D2A5E, 0x80


class SeekableWriter:
    """Appends frames to a binary stream and closes with the index and the seek table."""

    def __init__(self, out, level: int = 3):
        self.out, self.entries = out, []
        self.zip = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)

    def frame(self, raw: bytes) -> int:
        got = self.zip.compress(raw)
        self.out.write(got)
        self.entries.append((len(got), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        return len(self.entries) - 1

    def close(self, index: bytes) -> None:
        packed = self.zip.compress(index)
        self.out.write(struct.pack("<II", SKIP_INDEX, len(packed)) + packed)
        table = b"".join(struct.pack("<III", *e) for e in self.entries)
        self.out.write(struct.pack("<II", SKIP_TABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.entries), HAS_CHECKSUMS, SEEK_MAGIC))


class SeekableReader:
    """Reads single frames and the index of a file written by ``SeekableWriter``."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEK_MAGIC or flags != HAS_CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        table = np.frombuffer(source.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3)
        self.packed, self.raw, self.sums = (table[:, i].astype(np.int64) for i in range(3))
        self.at = np.concatenate(([0], np.cumsum(self.packed)))
        self.unzip = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        raw = self.unzip.decompress(self.source.read_at(int(self.packed[k]), int(self.at[k])), max_output_size=max(1, int(self.raw[k])))
        if len(raw) != self.raw[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} fails its checksum")
        return raw

    def index(self) -> bytes:
        magic, n = struct.unpack("<II", self.source.read_at(8, int(self.at[-1])))
        if magic != SKIP_INDEX:
            raise ValueError("no document index after the frames")
        return self.unzip.decompress(self.source.read_at(n, int(self.at[-1]) + 8))


class _Remembered:
    """Ids of words met before in this worker, up to a bound."""

    def __init__(self, path: str):
        self.bpe = word_bpe(path)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.lens = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def table(self, words: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self._clear()
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            ids, lens = self.bpe.encode(new)
            base = len(known)
            self.known.update(zip(new, range(base, base + len(new)), strict=True))
            self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(lens) - lens))
            self.lens = np.concatenate((self.lens, lens))
            self.flat = np.concatenate((self.flat, ids))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


_REMEMBERED: dict[str, _Remembered] = {}


def _write(path: str, folder: str, end_id: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mem = _REMEMBERED.setdefault(path, _Remembered(path))
        width = "<u2" if len(mem.bpe.pieces) <= 1 << 16 and end_id < 1 << 16 else "<u4"
        fs, root = filesystem(folder)
        part, seq, out, name, files = TaskContext.get().partitionId(), 0, None, "", []
        doc_ids: list[int | None] = []
        sizes: list[np.ndarray] = []
        docs_in_frame: list[int] = []
        held: list[np.ndarray] = []
        held_n = held_docs = 0

        def flush() -> None:
            nonlocal held, held_n, held_docs
            w.frame(np.concatenate(held).astype(width).tobytes())
            docs_in_frame.append(held_docs)
            held, held_n, held_docs = [], 0, 0

        def close() -> None:
            nonlocal out, seq, doc_ids, sizes, docs_in_frame
            if held_docs:
                flush()
            n_tokens = np.concatenate(sizes)
            ids_ = np.array([x if x is not None else 0 for x in doc_ids], "<i8")
            none = np.array([x is None for x in doc_ids], np.uint8)
            header = json.dumps({"docs": len(ids_), "frames": len(docs_in_frame), "width": width, "end_id": end_id}).encode()
            w.close(struct.pack("<I", len(header)) + header + ids_.tobytes() + none.tobytes() + n_tokens.astype("<i8").tobytes() + np.array(docs_in_frame, "<i8").tobytes())
            out.close()
            files.append((part, seq, name, len(ids_), int(n_tokens.sum())))
            out, seq, doc_ids, sizes, docs_in_frame = None, seq + 1, [], [], []

        for b in batches_of(it, "text", BATCH_BYTES):
            if out is None:
                name = f"part-{part:06d}-{seq:04d}-{uuid.uuid4().hex[:12]}.tok.zst"
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
                w = SeekableWriter(out, level=1)
            words, codes, head, count = mem.bpe.split(strings(b.column(1)))
            place = mem.table(words.to_pylist())
            codes = place[codes[spread(head, count)]]
            lens = mem.lens[codes]
            ids = mem.flat[spread(mem.start[codes], lens)]
            ends = np.concatenate(([0], np.cumsum(lens)))[np.cumsum(count)]
            with_end = np.full(len(ids) + len(ends), end_id, np.uint32)
            mask = np.ones(len(with_end), bool)
            mask[ends + np.arange(len(ends))] = False
            with_end[mask] = ids
            n_each = np.diff(np.concatenate(([0], ends))) + 1
            doc_ids += b.column(0).to_pylist()
            sizes.append(n_each)
            z = np.cumsum(n_each)
            at = 0
            while at < len(z):  # whole documents to a frame
                base = z[at - 1] if at else 0
                stop = min(len(z), max(at + 1, int(np.searchsorted(z, base + FRAME_IDS - held_n, side="right"))))
                held.append(with_end[base : z[stop - 1]])
                held_n += int(z[stop - 1] - base)
                held_docs += stop - at
                at = stop
                if held_n >= FRAME_IDS or at < len(z):
                    flush()
            if sum(int(x.sum()) for x in sizes) >= FILE_IDS or len(doc_ids) >= FILE_DOCS:
                close()
        if out is not None:
            close()
        give_back()
        if files:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*files, strict=True)], ["part", "seq", "name", "docs", "tokens"])

    return run


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Writes the ids of all documents, in ascending id order, and returns the list of files.

    One file for each range of ids, or more of FILE_IDS ids each; ``manifest.json`` beside them lists those
    of the attempts that succeeded, with documents and ids before each, so a
    retried task leaves at most a file that nothing reads. A null text is
    empty (its end id alone); null document ids come first; repeated ids are
    ordered by their text and stand in one range; very long texts are a frame of
    their own; other columns are left out; an empty table gives an empty manifest.
    """
    ship(docs.sparkSession)
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = by_id_order(rows, "id").sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first()).select("id", "text")
    files = sorted((r.asDict() for r in ordered.mapInArrow(_write(path, folder, end_id), "part long, seq long, name string, docs long, tokens long").collect()), key=lambda r: (r["part"], r["seq"]))
    at = 0
    for f in files:
        f["start"] = at
        at += f["tokens"]
    with fs.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps({"files": files}).encode())
    return files


def _layout(reader: SeekableReader) -> tuple[dict, list[int | None], np.ndarray, np.ndarray]:
    raw = reader.index()
    (k,) = struct.unpack("<I", raw[:4])
    head = json.loads(raw[4 : 4 + k])
    n, at = head["docs"], 4 + k
    ids = np.frombuffer(raw, "<i8", n, at).tolist()
    none = np.frombuffer(raw, np.uint8, n, at + 8 * n)
    sizes = np.frombuffer(raw, "<i8", n, at + 9 * n)
    per_frame = np.frombuffer(raw, "<i8", head["frames"], at + 17 * n)
    return head, [None if z else i for i, z in zip(ids, none, strict=True)], sizes, per_frame


Project = Callable[[list, list, list[np.ndarray]], dict[str, list]]


def _real(ids: list, starts: list, tokens: list[np.ndarray]) -> dict[str, list]:
    return {"doc_id": ids, "start": starts, "ids": tokens}


REAL_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _read(folder: str, project: Project, schema: pa.Schema):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for b in it:
            for f in b.to_pylist():
                with fs.open_input_file(f"{root}/{f['name']}") as source:
                    reader = SeekableReader(source)
                    head, ids, sizes, per_frame = _layout(reader)
                    doc, start = 0, f["start"]
                    for k, n in enumerate(per_frame.tolist()):
                        tokens = np.frombuffer(reader.frame(k), head["width"])
                        ends = np.cumsum(sizes[doc : doc + n])
                        begins = ends - sizes[doc : doc + n]
                        cols = project(ids[doc : doc + n], (start + begins).tolist(), [tokens[a:z] for a, z in zip(begins, ends, strict=True)])
                        yield pa.RecordBatch.from_pydict(cols, schema=schema)
                        doc, start = doc + n, start + int(ends[-1])

    return run


def read_tokens(spark: SparkSession, folder: str, project: Project = _real, schema: pa.Schema = REAL_SCHEMA) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it) and ``ids`` of every document in ``folder``.

    Null and repeated document ids, empty texts and very long ones come back as
    they were written; a folder of an empty table gives an empty one.
    ``project`` turns them into other columns within the same pass.
    """
    from pyspark.sql.pandas.types import from_arrow_schema

    ship(spark)
    fs, root = filesystem(folder)
    with fs.open_input_file(f"{root}/manifest.json") as f:
        files = json.loads(f.read())["files"]
    rows = [(i, f["name"], f["start"]) for i, f in enumerate(files)]
    df = spark.createDataFrame(rows, "k int, name string, start long")
    return df.repartitionById(max(1, len(rows)), F.col("k")).mapInArrow(_read(folder, project, schema), from_arrow_schema(schema))


def read_documents(folder: str, wanted: set[int]) -> dict[int, np.ndarray]:
    """The ids of single documents, from their frames alone; ids that aren't there are left out, of repeated ones the last counts."""
    fs, root = filesystem(folder)
    with fs.open_input_file(f"{root}/manifest.json") as f:
        files = json.loads(f.read())["files"]
    out: dict[int, np.ndarray] = {}
    for f in files:
        with fs.open_input_file(f"{root}/{f['name']}") as source:
            reader = SeekableReader(source)
            head, ids, sizes, per_frame = _layout(reader)
            doc = 0
            for k, n in enumerate(per_frame.tolist()):
                if wanted.intersection(x for x in ids[doc : doc + n] if x is not None):
                    tokens = np.frombuffer(reader.frame(k), head["width"])
                    ends = np.cumsum(sizes[doc : doc + n])
                    for i, a, z in zip(ids[doc : doc + n], ends - sizes[doc : doc + n], ends, strict=True):
                        if i in wanted:
                            out[i] = tokens[a:z]
                doc += n
    return out


def write_and_read(docs: DataFrame, path: str, end_id: int, project: Project = _real, schema: pa.Schema = REAL_SCHEMA, folder: str | None = None) -> DataFrame:
    """Writes the files (to the shared folder if none is given) and reads them back."""
    folder = folder or new_dir(docs.sparkSession, "tokens")
    write_tokens(docs, folder, path, end_id)
    return read_tokens(docs.sparkSession, folder, project, schema)
