import os
import subprocess
import sys

import corpus_pipeline as P
from conftest import SF
from helpers import DOCS, ODD, PASSAGE, table
from test_decontaminate import brute as brute_leaks
from test_simhash import brute_similar

from skerry.llm.common import cut, read_table
from skerry.llm.pii import redact, spans
from skerry.llm.quality import fit
from skerry.llm.queries_bpe import tokenizer_path
from skerry.llm.queries_quality import THRESHOLD
from skerry.llm.words import word_bpe

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_equals_brute_force(spark):
    docs = read_table(spark, SF, "documents")
    rows = [tuple(r) for r in docs.collect()]
    model = fit(docs, read_table(spark, SF, "labels"))
    rows = [r for r, s in zip(rows, model.score([r[1] for r in rows]), strict=True) if s >= THRESHOLD]
    keep = {d for d, c in brute_similar(rows) if d == c}
    rows = [r for r in rows if r[0] in keep]
    bad = {d for d, _ in brute_leaks(rows, [tuple(r) for r in read_table(spark, SF, "benchmark").collect()])}
    rows = [(r[0], redact(r[1], spans(r[1]))) for r in rows if r[0] not in bad]
    bpe = word_bpe(tokenizer_path()).whole
    want = {d: bpe.encode(t, add_special_tokens=False).ids for d, t in rows}
    got = {r["doc_id"]: r["ids"] for r in P.run(spark, SF).collect()}
    assert got == want and len(got) > 100


def test_stages_keep_columns_and_survive_odd_rows(spark, tmp_path):
    sf = table(spark, tmp_path, "documents", ODD, DOCS)
    table(spark, tmp_path, "labels", [(1, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    table(spark, tmp_path, "benchmark", [(1, PASSAGE)], "item_id long, text string")
    for rows in (ODD, []):
        table(spark, tmp_path, "documents", rows, DOCS)
        docs = read_table(spark, sf, "documents")
        for i, (_, stage) in enumerate(P.STAGES):
            out = cut(stage(spark, docs, sf))
            if i < len(P.STAGES) - 1:
                assert out.columns == docs.columns
            docs = out
        assert (docs.count() > 0) == bool(rows)


def test_the_rest_works_without_this_subpackage(tmp_path):
    import shutil

    to = tmp_path / "repo"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [x for x in q if x.startswith('op') or x == 'pipeline'] and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=to)
