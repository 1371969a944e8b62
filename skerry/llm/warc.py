"""WARC records in seekable Zstandard bundles.

A bundle holds groups of records as independent zstandard frames, a skippable
frame that maps record identifiers to (frame, offset, length), and a trailing
seek table. Records of equal payload are written once; the others are revisit
records that refer to the one of the smallest page id.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import batches_of, cut, filesystem, look_up, new_dir, ship
from skerry.llm.tokenfile import SeekableReader, SeekableWriter

FRAME_BYTES = 1_000_000
BUNDLE_BYTES = 256_000_000
BATCH_BYTES = 8_000_000
#: Records carry one date, so that a task that runs twice writes the same bytes.
DATE = "1970-01-01T00:00:00Z"


def sha1_base32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _one_line(text: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in text)


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, an HTTP message that holds the payload, or, with ``refers_to``, a revisit record (its block is empty).

    Digest and length are the full payload's in both. Record ids are the pages'
    ids, so that rows of one page id share theirs.
    """
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {_one_line(url or '')}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else b""
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record in a frame; a revisit's is empty."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no record where one should begin")
        head = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])}
        size = int(head["content-length"])
        block = raw[end + 4 : end + 4 + size]
        yield head, block.partition(b"\r\n\r\n")[2]
        at = end + 4 + size + 4


def _page_of(urn: str) -> int | None:
    got = urn.removeprefix("<urn:x-page:").removesuffix(">")
    return None if got == "null" else int(got)


def _write(folder: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        part, seq, w = TaskContext.get().partitionId(), 0, None
        done: list[tuple[str, int]] = []

        def close() -> None:
            nonlocal w, seq
            if frame:
                flush()
            w.close(json.dumps(index).encode())
            out.close()
            done.append((name, len(index)))
            w, seq = None, seq + 1

        def flush() -> None:
            nonlocal frame, held
            w.frame(b"".join(frame))
            frame, held = [], 0

        frame: list[bytes] = []
        held = written = 0
        index: list = []
        for b in batches_of(it, "payload", BATCH_BYTES):
            for page_id, url, payload, refers_to in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if w is None:
                    name = f"bundle-{part:06d}-{seq:04d}-{uuid.uuid4().hex[:12]}.warc.zst"
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    w, index, written = SeekableWriter(out), [], 0
                rec = build_record(page_id, url, payload or b"", refers_to)
                index.append((record_id(page_id), len(w.entries), held, len(rec)))
                frame.append(rec)
                held += len(rec)
                written += len(rec)
                if held >= FRAME_BYTES:
                    flush()
                if written >= BUNDLE_BYTES:
                    close()
        if w is not None:
            close()
        yield pa.RecordBatch.from_pydict({"name": [x for x, _ in done], "records": [n for _, n in done]}, schema=pa.schema([("name", pa.string()), ("records", pa.int64())]))

    return run


def revisits(pages: DataFrame, id_col: str, payload: str, least_bytes: int) -> DataFrame:
    """(page_id, key, refers_to) of the rows whose payload a smaller page id has too.

    Only ids and payload hashes are shuffled; the smallest id of each hash
    comes from a pre-aggregated sum, and frequent hashes are looked up apart, so
    one payload may hold any share of the rows.
    """
    keyed = cut(pages.filter(F.octet_length(payload) >= least_bytes).select(F.col(id_col).alias("page_id"), F.sha2(payload, 256).alias("key")))
    seen = cut(keyed.groupBy("key").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    return look_up(keyed, seen, "key").filter("page_id > refers_to").distinct()


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> int:
    """Writes a record for every row; returns the number of records.

    Payload: the column's UTF-8 (null: empty). Of rows with equal payloads of
    ``least_bytes`` or more, those of the smallest page id are responses and
    the others revisit records; rows with a null page id are responses.
    Repeated rows give a record each; very long payloads are a frame of their
    own; other columns are left out; an empty table gives no bundle.
    ``manifest.json`` lists the bundles of the attempts that succeeded. Where
    the list of revisits is beyond Spark's broadcast limit, rows are joined to
    it by a shuffle of ids, urls and payloads.
    """
    ship(pages.sparkSession)
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload")
    )
    again = cut(revisits(rows, "page_id", "payload", least_bytes)).withColumnRenamed("page_id", "again_id")
    joined = rows.withColumn("own", F.sha2("payload", 256)).join(again, (F.col("page_id") == F.col("again_id")) & (F.col("own") == F.col("key")), "left")
    got = joined.select("page_id", "url", "payload", "refers_to").mapInArrow(_write(folder), "name string, records long").collect()
    with fs.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps({"bundles": sorted([r["name"], r["records"]] for r in got)}).encode())
    return sum(r["records"] for r in got)


Project = Callable[[list[tuple[dict[str, str], bytes]]], dict[str, list]]


def _real(records: list[tuple[dict[str, str], bytes]]) -> dict[str, list]:
    return {
        "page_id": [_page_of(h["warc-record-id"]) for h, _ in records],
        "url": [h["warc-target-uri"] for h, _ in records],
        "record_type": [h["warc-type"] for h, _ in records],
        "payload_digest": [h["warc-payload-digest"].removeprefix("sha1:") for h, _ in records],
        "payload_bytes": [int(h["warc-payload-length"]) for h, _ in records],
        "refers_to": [_page_of(h["warc-refers-to"]) if "warc-refers-to" in h else None for h, _ in records],
        "block": [b for _, b in records],
    }


REAL_SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("block", pa.binary())]
)


def _read(folder: str, project: Project, schema: pa.Schema):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for b in it:
            for name in b.column(1).to_pylist():
                with fs.open_input_file(f"{root}/{name}") as source:
                    reader = SeekableReader(source)
                    for k in range(len(reader.packed)):
                        yield pa.RecordBatch.from_pydict(project(list(parse_records(reader.frame(k)))), schema=schema)

    return run


def read_bundles(spark: SparkSession, folder: str, project: Project = _real, schema: pa.Schema = REAL_SCHEMA) -> DataFrame:
    """Every record of every bundle in ``folder``: ids, types, digests and payloads (``block``; empty for revisits).

    Null ids and urls, empty payloads and repeated rows come back as they were
    written (a null url as ''); a folder without bundles gives an empty table.
    """
    from pyspark.sql.pandas.types import from_arrow_schema

    ship(spark)
    fs, root = filesystem(folder)
    with fs.open_input_file(f"{root}/manifest.json") as f:
        names = [x for x, _ in json.loads(f.read())["bundles"]]
    df = spark.createDataFrame(list(enumerate(names)), "k int, name string")
    return df.repartitionById(max(1, len(names)), F.col("k")).mapInArrow(_read(folder, project, schema), from_arrow_schema(schema))


def read_record(folder: str, bundle: str, page_id: int) -> tuple[dict[str, str], bytes]:
    """One record, from its frame alone."""
    fs, root = filesystem(folder)
    with fs.open_input_file(f"{root}/{bundle}") as source:
        reader = SeekableReader(source)
        for key, frame, at, size in json.loads(reader.index()):
            if key == record_id(page_id):
                return next(parse_records(reader.frame(frame)[at : at + size]))
    raise KeyError(page_id)


def write_and_read(pages: DataFrame, project: Project = _real, schema: pa.Schema = REAL_SCHEMA, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    folder = folder or new_dir(pages.sparkSession, "warc")
    write_bundles(pages, folder, least_bytes=least_bytes)
    return read_bundles(pages.sparkSession, folder, project, schema)
