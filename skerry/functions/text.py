"""Text functions over columns: tokenizer, paragraph chunks, ids, small formats."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CHUNK_CHARS, MIN_CHUNK_CHARS = 1600, 200
WINDOW, OVERLAP = 500, 50

#: Characters that Unicode calls white space.
WHITE_SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: Where words break. Where a lower-case letter meets an upper-case one, an acronym a word, or letters digits.
_BOUNDARY = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[a-zA-Z])(?=[0-9])|(?<=[0-9])(?=[a-zA-Z])"
#: Such a place with the characters beside it, and a whole word that has one.
_BREAK = r"[a-z][A-Z]|[A-Z][A-Z][a-z]|[a-zA-Z][0-9]|[0-9][a-zA-Z]"
_BROKEN = rf"(?<![a-zA-Z0-9])[a-zA-Z0-9]*?(?:{_BREAK})[a-zA-Z0-9]*"
_SPACES = r"(?U)^\s+|\s+$"


def code_tokens(text: Column) -> Column:
    """Identifier-aware tokens, repeats kept.

    Words break at other characters than ASCII letters and digits and at camel,
    acronym and digit boundaries; a word that breaks is a token as a whole too.
    All are lower-cased, those of one character are dropped. Work stays on
    strings rather than on arrays of words, and prose without such words takes
    the short way.
    """
    plain = F.split(F.lower(text), "[^a-z0-9]+")
    parts = F.split(F.lower(F.regexp_replace(text, _BOUNDARY, " ")), "[^a-z0-9]+")
    wholes = F.transform(F.regexp_extract_all(text, F.lit(_BROKEN), F.lit(0)), F.lower)
    return F.filter(F.when(text.rlike(_BREAK), F.concat(parts, wholes)).otherwise(plain), lambda t: F.length(t) >= 2)


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, _SPACES, "")


def _cutter(most: int, least: int):
    """(pieces of a paragraph, chunks of a text) as functions of strings.

    Defined within, so that they go to executors by value.
    """
    paragraph_end, sentence_end = re.compile("\n\n+"), re.compile(rf"(?<=\.)[{WHITE_SPACE}]+")
    white = WHITE_SPACE

    def pack(items: list[str], glue: str) -> list[str]:
        """Joined greedily while they fit; what is longer than ``most`` is sliced, its slices stand alone."""
        out: list[str] = []
        cur: list[str] = []
        size = 0
        for s in items:
            if len(s) > most:
                out += [glue.join(cur)] if cur else []
                out += [s[i : i + most] for i in range(0, len(s), most)]
                cur, size = [], 0
            elif cur and size + len(glue) + len(s) <= most:
                cur.append(s)
                size += len(glue) + len(s)
            else:
                out += [glue.join(cur)] if cur else []
                cur, size = [s], len(s)
        return out + ([glue.join(cur)] if cur else [])

    def pieces(p: str) -> list[str]:
        return [p] if len(p) <= most else pack([s for s in sentence_end.split(p) if s], " ")

    def chunks(t: str) -> list[str]:
        whole = (p for p in (x.strip(white) for x in paragraph_end.split(t)) if p)
        got = pack([s for p in whole for s in pieces(p)], "\n\n")
        return got if len(got) == 1 else [c for c in got if len(c) >= least]

    return pieces, chunks


def _of_strings(f):
    """A function of strings as one of Arrow arrays; null stays null."""

    def run(col: pa.Array) -> pa.Array:
        return pa.array([None if t is None else f(t) for t in col.to_pylist()], pa.list_(pa.string()))

    run.__annotations__ = {"col": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<string>")


def sentence_pieces(paragraph: Column, most: int = MAX_CHUNK_CHARS) -> Column:
    """A paragraph as it is, or an oversized one's sentences packed to ``most`` characters; longer sentences are sliced."""
    return _of_strings(_cutter(most, 0)[0])(paragraph)


def paragraph_chunks(text: Column, most: int = MAX_CHUNK_CHARS, least: int = MIN_CHUNK_CHARS) -> Column:
    """Chunks at paragraph borders: trimmed, oversized ones split by sentences, small ones merged, undersized ones dropped unless alone.

    In Python over Arrow batches, linear in the text: as array expressions the
    same fold copied its arrays at each step and took several times as long.
    """
    return _of_strings(_cutter(most, least)[1])(text)


def token_windows(n: Column, window: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """(start, end) of sliding windows over n tokens, the end exclusive; the last one ends at n."""
    stride = window - overlap
    count = F.when(n <= window, F.lit(1)).otherwise(1 + F.ceil((n - window) / stride))
    return F.transform(F.sequence(F.lit(0), count.cast("int") - 1), lambda i: F.struct((i * stride).alias("start"), F.least(i * stride + window, n).alias("end")))


def chunk_id(path: Column, index: Column) -> Column:
    """Stable chunk id: 12 hex digits of the path's SHA-256 and the index in four digits or more."""
    return F.concat(F.substring(F.sha2(path, 256), 1, 12), F.lit("_"), F.format_string("%04d", index))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; none for names that begin with their only dot."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def last_segment(path: Column) -> Column:
    """What follows the last dot, with a dot: also for names that begin with it."""
    return F.concat(F.lit("."), F.lower(F.element_at(F.split(path, r"\."), -1)))


def normal_dir(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^\./", ""), "/$", "")


def safe_id(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z0-9._-]", "_")


def format_bytes(n: Column) -> Column:
    unit = lambda d, u: F.format_string(f"%.1f {u}", n / d)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, unit(1024, "KB")).when(n < 1024**3, unit(1024**2, "MB")).otherwise(unit(1024**3, "GB"))


def iso_time(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def r4(x: Column) -> Column:
    """Four decimals, halves up."""
    return F.floor(x * 10000 + 0.5) / 10000
