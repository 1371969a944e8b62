"""Files to chunks by type."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions.text import OVERLAP, WINDOW, chunk_id, content_hash, paragraph_chunks

#: Tokens of the built-in code tokenizer: runs of word characters, or single other ones.
TOKEN = r"\w+|[^\w\s]"


#: From a text to the (start, end) of its tokens, in characters, ascending.
Tokenizer = Callable[[str], Iterable[tuple[int, int]]]


def regex_tokenizer(pattern: str = TOKEN) -> Tokenizer:
    """Tokens by a regular expression; letters and digits are ASCII ones."""
    found = re.compile(pattern, re.ASCII)

    def run(text: str) -> list[tuple[int, int]]:
        return [m.span() for m in found.finditer(text)]

    return run


def windows(texts: DataFrame, tokenizer: Tokenizer | None = None, window: int = WINDOW, overlap: int = OVERLAP, text_col: str = "text") -> DataFrame:
    """The other columns with chunk_index, line_start, line_end, token_count, chunk_text: sliding windows over tokens.

    ``tokenizer`` is called on the executors; without one a text is cut by
    ``TOKEN``. A text of one window is one chunk whole. A window's text begins
    where the token before it ends; its lines are those of its first and last
    tokens. Tokens, ends of lines and windows are each gone over once, so the
    time is linear in the text. Null texts have no chunk.
    """
    others = [c for c in texts.columns if c != text_col]
    cut, step = tokenizer or regex_tokenizer(), window - overlap
    part = texts.filter(F.col(text_col).isNotNull()).select(*others, F.col(text_col).alias(text_col))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            row, index, first, last, count, body = [], [], [], [], [], []
            for i, t in enumerate(b.column(len(others)).to_pylist()):
                spans = np.fromiter((x for s in cut(t) for x in s), np.int64).reshape(-1, 2)
                n = len(spans)
                ends_of_lines = np.flatnonzero(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) == 10)
                lines = len(ends_of_lines) + 1
                if n <= window:
                    row.append(i), index.append(0), first.append(1), last.append(lines), count.append(n), body.append(t)
                    continue
                begin = np.arange(0, n - overlap, step)
                end = np.minimum(begin + window, n)
                starts, stops = spans[begin, 0], spans[end - 1, 1]
                heads = np.where(begin > 0, spans[begin - 1, 1], 0)
                row += [i] * len(begin)
                index += range(len(begin))
                first += (np.searchsorted(ends_of_lines, starts) + 1).tolist()
                last += (np.searchsorted(ends_of_lines, stops - 1) + 1).tolist()
                count += (end - begin).tolist()
                body += [t[x:y] for x, y in zip(heads.tolist(), stops.tolist(), strict=True)]
            kept = [c.take(pa.array(row, pa.int64())) for c in b.columns[: len(others)]]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(x, pa.int32()) for x in (index, first, last, count)], pa.array(body, pa.string())], [*b.schema.names[: len(others)], "chunk_index", "line_start", "line_end", "token_count", "chunk_text"])

    kinds = ", ".join(f"`{c}` {part.schema[c].dataType.simpleString()}" for c in others)
    return part.mapInArrow(run, f"{kinds}, chunk_index int, line_start int, line_end int, token_count int, chunk_text string")


def code_chunks(files: DataFrame, tokenizer: Tokenizer | None = None) -> DataFrame:
    """Windows over the tokens of files (path, type, text)."""
    return windows(files.select("path", "type", "text"), tokenizer)


def text_chunks(files: DataFrame) -> DataFrame:
    f = files.select("path", "type", F.posexplode(paragraph_chunks(F.col("text"))).alias("chunk_index", "chunk_text"))
    return f.select("path", "type", "chunk_index", F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), F.length("chunk_text").alias("token_count"), "chunk_text")


def image_chunks(files: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return files.select("path", "type", zero.alias("chunk_index"), zero.alias("line_start"), zero.alias("line_end"), zero.alias("token_count"), F.lit("").alias("chunk_text"))


def all_chunks(files: DataFrame, tokenizer: Tokenizer | None = None) -> DataFrame:
    """Chunks of all files (path, type, text), with ids and text hashes; ``tokenizer`` cuts code."""
    kinds = {"code": lambda f: code_chunks(f, tokenizer), "text": text_chunks, "image": image_chunks}
    out = None
    for kind, cut in kinds.items():
        part = cut(files.filter(F.col("type") == kind))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("id", chunk_id(F.col("path"), F.col("chunk_index"))).withColumn("text_hash", content_hash(F.col("chunk_text")))
