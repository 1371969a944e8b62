"""Text of PDF files through a reader that is plugged in, or through pypdf where that is installed."""

from __future__ import annotations

import importlib.util
import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Reader = Callable[[bytes], str]


def pypdf_text(data: bytes) -> str:
    import pypdf

    return "\n\n".join(page.extract_text() for page in pypdf.PdfReader(io.BytesIO(data)).pages)


def default_reader() -> Reader | None:
    return pypdf_text if importlib.util.find_spec("pypdf") else None


def extract(data: bytes, reader: Reader) -> str:
    try:
        return reader(data)
    except Exception as e:
        raise ValueError(f"PDF text extraction failed: {e}") from e


def with_text(files: DataFrame, reader: Reader | None) -> DataFrame:
    """(path, type, text) of rows with path, type and content. A file that can't be read has no text, nor has any without a reader."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for data in b.column(2).to_pylist():
                try:
                    out.append(extract(data or b"", reader) if reader else "")
                except ValueError:
                    out.append("")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["path", "type", "text"])

    return files.select("path", "type", "content").mapInArrow(run, "path string, type string, text string")
