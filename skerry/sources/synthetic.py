"""Seeded synthetic files for benchmarks: the same on every machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The generator's multiplier, increment and mask.
MULTIPLIER, INCREMENT, MASK = 1103515245, 12345, 0x7FFFFFFF

NAMES = "user order token cache index query parser stream buffer client".split()
VERBS = "load save parse build merge update render fetch check close".split()


def numbers(seed: int) -> Iterator[int]:
    state = seed & MASK
    while True:
        state = (state * MULTIPLIER + INCREMENT) & MASK
        yield state >> 8


def code_file(lines: int, seed: int) -> str:
    g = numbers(seed)
    word = lambda xs: xs[next(g) % len(xs)]
    out = []
    for i in range(lines):
        out.append(f"def {word(VERBS)}_{word(NAMES)}_{i}(value):" if i % 5 == 0 else f"    {word(NAMES)}{next(g) % 100} = {word(VERBS)}{word(NAMES).capitalize()}(value, {next(g) % 1000})")
    return "\n".join(out)


def text_file(chars: int, seed: int) -> str:
    g, out, size = numbers(seed), [], 0
    while size < chars:
        n = 5 + next(g) % 12
        s = " ".join((NAMES + VERBS)[next(g) % 20] for _ in range(n)).capitalize() + ("." if next(g) % 6 else ".\n\n")
        out.append(s)
        size += len(s) + 1
    return " ".join(out)[:chars]


def corpus(spark: SparkSession, n: int, lines: int = 100, chars: int = 4000, seed: int = 1) -> DataFrame:
    """(path, type, text) of n files, code and text in turn, made on the executors."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            ids = df["id"].tolist()
            kind = ["code" if i % 2 == 0 else "text" for i in ids]
            text = [code_file(lines, seed + i) if k == "code" else text_file(chars, seed + i) for i, k in zip(ids, kind, strict=True)]
            yield pd.DataFrame({"path": [f"gen/{k}_{i}.{'py' if k == 'code' else 'md'}" for i, k in zip(ids, kind, strict=True)], "type": kind, "text": text})

    return spark.range(n).select(F.col("id")).mapInPandas(run, "path string, type string, text string")
