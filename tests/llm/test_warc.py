import base64
import hashlib

from conftest import SF
from helpers import multiset, table
from oracle import differences, duck

from skerry.llm import warc
from skerry.llm.common import new_dir
from skerry.llm.queries_warc import OP9_SQL, op9_warc

PAGES = "page_id long, url string, html string"
ROWS = [(1, "u", "a"), (2, None, "a"), (3, "x", None), (4, "y", ""), (None, "z", "a"), (2, "q\r\nWARC-Type: x", "a"), (9, "u", "\r\n\r\nWARC/1.1 é" * 3), (5, "v", "a"), (5, "v", "a")]


def test_equals_sql(spark):
    assert differences(spark, duck(SF), op9_warc, OP9_SQL, SF) == []


def test_odd_rows(spark, tmp_path):
    got = multiset(tuple(r) for r in op9_warc(spark, table(spark, tmp_path, "pages", ROWS, PAGES)).collect())
    want = []
    for p, _, h in ROWS:
        raw = (h or "").encode()
        first = min(q for q, _, g in ROWS if (g or "") == (h or "") and q is not None)
        again = p is not None and p > first
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert got == multiset(want)
    assert op9_warc(spark, table(spark, tmp_path, "pages", [], PAGES)).count() == 0


def test_least_bytes_blocks_and_single_records(spark):
    folder = new_dir(spark, "test")
    df = spark.createDataFrame(ROWS, PAGES)
    assert warc.write_bundles(df, folder, least_bytes=2) == len(ROWS)
    rows = warc.read_bundles(spark, folder).collect()
    assert {r["record_type"] for r in rows} == {"response"}
    assert multiset((r["page_id"], bytes(r["block"])) for r in rows) == multiset((p, (h or "").encode()) for p, _, h in ROWS)
    import json

    fs, root = warc.filesystem(folder)
    with fs.open_input_file(f"{root}/manifest.json") as f:
        names = [n for n, _ in json.loads(f.read())["bundles"]]
    found = 0
    for n in names:
        try:
            head, block = warc.read_record(folder, n, 9)
        except KeyError:
            continue
        found += 1
        assert block == ROWS[6][2].encode() and head["warc-type"] == "response"
    assert found == 1


def test_records_parse_back():
    raw = b"".join(warc.build_record(i, "u", b"x" * i, None if i % 2 else 0) for i in range(50))
    got = list(warc.parse_records(raw))
    assert len(got) == 50 and all(len(b) == (i if i % 2 else 0) for i, (_, b) in enumerate(got))
