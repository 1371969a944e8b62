"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, digits, plus signs, schemes
and identifier cues. From each anchor a small deterministic parser expands to
the left and right and validates the span. Parsers of one kind move a cursor,
so spans of a kind never overlap and come leftmost first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import batches_of, numbered, place, ship, strings

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "iban", "ssn", "account", "secret")
KINDS = BASE + ADDED
BATCH_BYTES = 8_000_000

#: Words that announce an identifier, with the kind that they announce.
CUES = {
    "iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account", "konto": "account", "cuenta": "account", "compte": "account",
    "passport": "account", "token": "secret", "api_key": "secret", "apikey": "secret", "api key": "secret", "secret": "secret", "password": "secret", "passwd": "secret",
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE_RUN = re.compile(r"[\x20().0-9-]+")
_DIGITS = re.compile(r"[0-9]+")
_USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=:-]+@[A-Za-z0-9.-]+(?::[0-9]+)?")
_IBAN = re.compile(r"[\x20:=#]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_SSN = re.compile(r"[\x20:=#]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_ACCOUNT = re.compile(r"(?:\x20?(?:number|no\.?|nr\.?|num\.?))?[\x20:=#]{0,3}([0-9](?:[\x20-]?[0-9]){5,33})(?![0-9])")
_SECRET = re.compile(r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9_+/=.-]{16,})")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    raw = text.replace(" ", "")
    if not 15 <= len(raw) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 == 1


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    for w, kind in CUES.items():
        for form in {w, w.upper(), w.capitalize(), w.title()}:
            a.add_word(form, (kind, len(w)))
    a.make_automaton()
    return a


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, ordered by start and then kind.

    Base kinds equal leftmost non-overlapping matches of their patterns, less
    those that fail validation; added kinds are found by their own anchors.
    """
    if not text:
        return []
    out: list[tuple[int, int, str, int]] = []
    end = dict.fromkeys(KINDS, 0)
    digit_run = 0
    for last, (kind, size) in automaton().iter(text):
        p = last - size + 1
        if kind == "digit":
            if p < digit_run:
                continue
            digit_run = run = _DIGITS.match(text, p).end()
            if p >= end["card"] or run > end["card"]:
                m = _CARD.match(text, max(p, end["card"]))
                if m:
                    end["card"] = m.end()
                    if m.end() - m.start() >= 12:
                        digits = _NOT_DIGIT.sub("", m[0])
                        if 12 <= len(digits) <= 19 and luhn(digits):
                            out.append((m.start(), 2, "card", m.end()))
            if (p >= end["ip"] or run > end["ip"]) and run < len(text) and text[run] == ".":
                m = _IP.match(text, max(p, end["ip"]))
                if m:
                    end["ip"] = m.end()
                    if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.groups()):
                        out.append((m.start(), 1, "ip", m.end()))
        elif kind == "at":
            stop, s = end["email"], p
            while s > stop and text[s - 1] in _LOCAL:
                s -= 1
            if s < p and (m := _DOMAIN.match(text, p + 1)):
                end["email"] = m.end()
                out.append((s, 0, "email", m.end()))
        elif kind == "plus":
            if p >= end["phone"] and "0" <= text[p + 1 : p + 2] <= "9" and (m := _PHONE_RUN.match(text, p + 2)):
                z = m.end()
                while z > p + 2 and not "0" <= text[z - 1] <= "9":
                    z -= 1
                if z > p + 3:
                    end["phone"] = z
                    if 9 <= len(_NOT_DIGIT.sub("", text[p:z])) <= 15:
                        out.append((p, 3, "phone", z))
        elif kind == "scheme":
            s = p
            while s > end["url"] and (text[s - 1].isascii() and text[s - 1].isalpha()):
                s -= 1
            if s < p and (m := _USERINFO.match(text, p + 3)):
                end["url"] = m.end()
                out.append((s, 4, "url", m.end()))
        else:
            z = p + size
            if z < end[kind] or p and text[p - 1].isalnum():
                continue
            m = {"iban": _IBAN, "ssn": _SSN, "account": _ACCOUNT, "secret": _SECRET}[kind].match(text, z)
            if m and (kind != "iban" or iban_ok(m[1])):
                end[kind] = m.end(1)
                out.append((m.start(1), KINDS.index(kind), kind, m.end(1)))
    out.sort()
    return [(k, s, e) for s, _, k, e in out]


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    i = 0
    while i < len(found):
        kind, s, e = found[i]
        i += 1
        while i < len(found) and found[i][1] < e:
            e = max(e, found[i][2])
            i += 1
        out.append(text[at:s])
        out.append(f"[{kind.upper()}]")
        at = e
    out.append(text[at:])
    return "".join(out)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``spans array<struct<kind,start,end>>`` of every whole text (null: empty, no spans).

    One row for each row, whatever is null or repeated; very long texts are read
    whole; of spans that begin together the order is that of KINDS; other
    columns are left out, whatever their names; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, spans array<struct<kind: string, start: long, end: long>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it, "text", BATCH_BYTES):
            got = [[{"kind": k, "start": s, "end": e} for k, s, e in spans(t)] for t in strings(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def redact_documents(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with personal data in ``text_col`` replaced; ``size_col`` follows the new text.

    A null text stays null, an empty one empty; overlapping spans become one,
    named by the first; repeated rows are changed alike; very long texts are read
    whole; columns of any name stay; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    plain, text = numbered(docs), place(docs, text_col)
    at = docs.columns.index(text_col)
    size_at = docs.columns.index(size_col) if size_col in docs.columns else None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it, text, BATCH_BYTES):
            texts = [None if t is None else redact(t, spans(t)) for t in b.column(at).to_pylist()]
            cols = list(b.columns)
            cols[at] = pa.array(texts, b.schema.field(at).type)
            if size_at is not None:
                cols[size_at] = pa.array([old if t is None else len(t) for t, old in zip(texts, cols[size_at].to_pylist(), strict=True)], b.schema.field(size_at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
