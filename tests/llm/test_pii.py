import hashlib
import random
import re

from conftest import SF
from helpers import DOCS, ODD, docs, table

from skerry.llm.common import read_table
from skerry.llm.pii import BASE, KINDS, find, luhn, redact, redact_documents, spans
from skerry.llm.queries_pii import op8_pii


def brute(t):
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def base(t):
    return [(s, KINDS.index(k), k, e) for k, s, e in spans(t) if k in BASE]


def test_base_spans_equal_the_patterns():
    rnd = random.Random(8)
    for _ in range(40_000):
        pool = rnd.choice(["0123 .-@a", "01+().- 9", "ab.@-%c1.2", "0123456789- ", "25.3 .1.2.3", "4111111111111111 -", "é@1.٣+5"])
        t = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40)))
        assert base(t) == brute(t), t


def test_added_kinds():
    t = 'IBAN: GB82 WEST 1234 5698 7654 32, SSN 123-45-6789, account no. 12345678, token = "abcdef0123456789abcdef", https://user:pw@host.example:80/x'
    got = {k: t[s:e] for k, s, e in spans(t) if k not in BASE}
    assert got == {"iban": "GB82 WEST 1234 5698 7654 32", "ssn": "123-45-6789", "account": "12345678", "secret": "abcdef0123456789abcdef", "url": "https://user:pw@host.example:80"}
    assert "GB83" in "GB83 WEST" and not [x for x in spans("IBAN: GB83 WEST 1234 5698 7654 32") if x[0] == "iban"]


def test_long_runs_stay_linear():
    assert spans("a" * 2_000_000) == [] and spans("@" * 200_000) == [] and spans("1" * 500_000) == [] and spans("+1" * 200_000) == []


def test_redact():
    t = "mail a@b.co now, 10.0.0.1"
    assert redact(t, spans(t)) == "mail [EMAIL] now, [IP]"
    assert redact("abcdef", [("x", 0, 3), ("y", 2, 5)]) == "[X]f" and redact("", []) == ""


def test_op8_equals_the_patterns(spark, tmp_path):
    for sf, rows in ((SF, [tuple(r) for r in read_table(spark, SF, "documents").collect()]), (table(spark, tmp_path, "documents", ODD, DOCS), ODD)):
        want = {}
        for d, t, *_ in rows:
            b = brute(t or "")
            want[d] = (*[sum(x[2] == k for x in b) for k in BASE], hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in b).encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for k, s, e in spans(t or "")))
        got = op8_pii(spark, sf).collect()
        assert len(got) == len(rows) and all(tuple(r)[1:] == want[r["doc_id"]] for r in got)


def test_operators_on_odd_rows(spark):
    assert find(docs(spark)).count() == len(ODD) and find(docs(spark).limit(0)).count() == 0
    d = docs(spark)
    got = redact_documents(d)
    assert got.schema == d.schema and redact_documents(d.limit(0)).count() == 0
    r = got.filter("doc_id = 1").first()
    assert "a.b@c.org" not in r["text"] and "[EMAIL]" in r["text"] and r["n_chars"] == len(r["text"])
    assert got.filter("doc_id = 2").first()["text"] is None
