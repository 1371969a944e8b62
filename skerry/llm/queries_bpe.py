"""op10 and op6: queries over the tokenizer operators."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skerry.llm.bpe import encode_decode
from skerry.llm.common import read_table
from skerry.llm.tokenfile import write_and_read

DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(ids: list, tokens: list, pieces: list[list[str]]) -> dict[str, list]:
    sha = lambda x: hashlib.sha256(x.encode("utf-8")).hexdigest()
    return {
        "doc_id": ids,
        "n_tokens": [len(t) for t in tokens],
        "ids_sha256": [sha(" ".join(map(str, t.tolist()))) for t in tokens],
        "decoded_sha256": [sha(" ".join(p)) for p in pieces],
    }


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read_table(spark, sf_dir, "documents"), tokenizer_path(), project=digests, schema=DIGEST)


FILE_DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
END_ID = 2


def file_digests(ids: list, starts: list, tokens: list) -> dict[str, list]:
    return {"doc_id": ids, "start": starts, "n_tokens": [len(t) for t in tokens], "ids_crc32": [zlib.crc32(t.astype("<u4").tobytes()) for t in tokens]}


def op6_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(read_table(spark, sf_dir, "documents"), tokenizer_path(), END_ID, project=file_digests, schema=FILE_DIGEST)
