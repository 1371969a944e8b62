import random
import re

from conftest import SF
from helpers import DOCS, ODD, docs, multiset, table

from skerry.llm.common import read_table
from skerry.llm.license_rules import STEMS
from skerry.llm.licenses import CONFIDENCE, PHRASES, rules, scan
from skerry.llm.queries_licenses import op5_license

RULES = [(label, priority, keywords.split(" & "), re.compile(pattern)) for label, priority, keywords, pattern in rules()]


def brute(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, base = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
    found = []
    if any(x in low for x in STEMS):
        for label, priority, keywords, pattern in RULES:
            if all(k in low for k in keywords):
                found += [(label, priority, m.start(), m.end()) for m in pattern.finditer(low)]

    def loses(a):
        for b in found:
            if b[2] <= a[2] and b[3] >= a[3] and (b[1] > a[1] or b[1] == a[1] and (b[3] - b[2] > a[3] - a[2] or b[0] < a[0])):
                return True
            if b[1] > a[1] and b[2] >= a[2] and b[3] <= a[3]:
                return True
        return False

    kept = [a for a in found if not loses(a)]
    score = max([CONFIDENCE[a[1]] for a in kept] + [CONFIDENCE[3] if places else 0.0])
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {a[0] for a in kept})), score


def same(spark, sf, rows):
    got = multiset((str(r["doc_id"]), str(tuple(r)[1:])) for r in op5_license(spark, sf).collect())
    assert got == multiset((str(d), str(brute(t or ""))) for d, t, *_ in rows)


def test_there_are_hundreds_of_rules_and_each_can_be_gated():
    assert len(RULES) > 200 and len({r[0] for r in RULES}) > 100


def test_equals_brute_force(spark, tmp_path):
    same(spark, SF, [tuple(r) for r in read_table(spark, SF, "documents").collect()])
    same(spark, table(spark, tmp_path, "documents", ODD, DOCS), ODD)
    rnd = random.Random(5)
    tokens = (
        "MIT License mit  license-mit license the Apache license, version 2.0 GNU Lesser General Public License v3 gpl GPL-2.0 licensed under cc by-nc-sa 4.0 released into the public domain "
        "SPDX-License-Identifier: Apache-2.0 é\n xmit licensex Affero general public license version 3 public domain bsd 3-clause license https://creativecommons.org/licenses/by/4.0/ GENERAL PUBLIC LICENSE"
    ).split(" ")
    rows = [(i, " ".join(rnd.choice(tokens) for _ in range(rnd.randint(0, 25))), None, None, None) for i in range(1500)]
    same(spark, table(spark, tmp_path, "documents", rows, DOCS), rows)
    assert op5_license(spark, table(spark, tmp_path, "documents", [], DOCS)).count() == 0


def test_suppression(spark):
    rows = [(1, "Licensed under the Apache License, Version 2.0.", None, None, None), (2, "GNU Lesser General Public License version 2.1", None, None, None)]
    got = {r["doc_id"]: [d["label"] for d in r["detections"]] for r in scan(docs(spark, rows)).collect()}
    assert got == {1: ["apache-2.0"], 2: ["lgpl-2.1"]}


def sample(rnd, nodes, sep):
    """A text that the parsed pattern matches; ``sep`` stands where words may be parted."""
    out = ""
    for op, arg in nodes:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "NOT_LITERAL":
            out += ","
        elif op == "BRANCH":
            out += sample(rnd, rnd.choice(arg[1]), sep)
        elif op == "SUBPATTERN":
            out += sample(rnd, arg[-1], sep)
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(sample(rnd, arg[2], sep) for _ in range(rnd.randint(arg[0], min(arg[1], max(arg[0], 2)))))
        elif op == "IN":
            fits = [c for c in (sep, ",", "x", "c", "s", "2") if any(str(k) == "LITERAL" and chr(v) == c or str(k) == "RANGE" and v[0] <= ord(c) <= v[1] or str(k) == "CATEGORY" and c == "x" for k, v in arg)]
            out += "," if str(arg[0][0]) == "NEGATE" else fits[0]
        else:
            assert op in ("ASSERT", "ASSERT_NOT"), op
    return out


def test_no_gate_keeps_a_rule_from_a_match(spark):
    rnd = random.Random(7)
    rows = []
    for label, _, keywords, pattern in RULES:
        for sep in "\n -\t":
            for _ in range(6):
                t = sample(rnd, re._parser.parse(pattern.pattern), sep)
                assert pattern.search(t), (pattern.pattern, t)
                assert all(k in t for k in keywords), (label, keywords, t)
                assert any(x in t for x in STEMS), (label, t)
                rows.append((len(rows), t, None, None, None))
    got = {r["doc_id"]: r["detections"] for r in scan(docs(spark, rows)).collect()}
    assert all(got[d] for d, *_ in rows)


def test_words_parted_by_line_ends(spark):
    texts = {
        "gpl-3.0": "GNU General Public\nLicense, version 3", "apache-2.0": "Apache\n License, Version 2.0", "cc-by": "Creative  Commons\nAttribution", "mpl-2.0": "Mozilla-Public-License 2.0",
        "cc-by-sa-4.0": "CC BY-SA 4.0", "perl": "under the same terms as\nPerl itself", "openrail": "Open RAIL-M license", "public-domain": "released into the Public\nDomain",
    }
    got = {r["doc_id"]: {d["label"] for d in r["detections"]} for r in scan(docs(spark, [(i, t, None, None, None) for i, t in enumerate(texts.values())])).collect()}
    assert all(label in got[i] for i, label in enumerate(texts)), got
