"""Pluggable embedders, applied in batches on the executors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.sources.shared import ship

#: Texts of one model call.
BATCH = 32

#: What is put before a query, by type of the chunks searched; documents get nothing.
PREFIXES = {
    "code": "Instruct: Given a search query, retrieve relevant code snippets\nQuery: ",
    "text": "Instruct: Given a search query, retrieve relevant text passages\nQuery: ",
}
#: Prompts whose mean stands for a query for images.
IMAGE_PROMPTS = ("a photo of {}", "an image of {}", "a picture of {}", "{}")


class Embedder(Protocol):
    model_id: str

    def embed(self, texts: list[str]) -> np.ndarray: ...

    def embed_images(self, images: list[bytes]) -> np.ndarray: ...


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.where(n > 0, v / np.where(n > 0, n, 1), v)


def shorten(v: np.ndarray, dims: int) -> np.ndarray:
    return unit(v[..., :dims])


class HashingEmbedder:
    """A bag of hashed words: for tests and offline use, it knows nothing of meaning."""

    model_id = "hashing-bag"

    def __init__(self, dims: int = 128):
        self.dims = dims

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.float32)
        for i, t in enumerate(texts):
            for w in "".join(c if c.isalnum() else " " for c in t.lower()).split():
                h = zlib.crc32(w.encode())
                out[i, h % self.dims] += 1 if h >> 16 & 1 else -1
        return unit(out)

    def embed_images(self, images: list[bytes]) -> np.ndarray:
        return self.embed([b.decode("latin-1") for b in images])


def ensemble(embedder: Embedder, text: str) -> np.ndarray:
    """The mean of the image prompts' vectors, at unit length."""
    return unit(embedder.embed([p.format(text) for p in IMAGE_PROMPTS]).mean(axis=0))


def embed_chunks(chunks: DataFrame, embedder: Embedder, column: str = "chunk_text", counted: Accumulator | None = None) -> DataFrame:
    """(id, path, type, model_id, text_hash, embedding) of rows with id, path, type, text_hash and the column: texts, or bytes of images.

    ``counted`` grows as tasks embed; those that run again count again.
    """
    ship(chunks.sparkSession)
    images = dict(chunks.dtypes)[column] == "binary"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                data = part.column(4).to_pylist()
                v = np.asarray(embedder.embed_images([x or b"" for x in data]) if images else embedder.embed([x or "" for x in data]), np.float32)
                if counted is not None:
                    counted.add(part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(list(v), pa.list_(pa.float32()))], ["id", "path", "type", "text_hash", "embedding"])

    got = chunks.select("id", "path", "type", "text_hash", column).mapInArrow(run, "id string, path string, type string, text_hash string, embedding array<float>")
    return got.withColumn("model_id", F.lit(embedder.model_id))
