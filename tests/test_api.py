import json
import os

import pytest

from skerry import api
from skerry.errors import EngineError
from skerry.operators.embedding import HashingEmbedder
from skerry.streaming import incremental


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/auth.ts").write_text("export function handleUserAuth(token) {\n  return verify(token)\n}\n")
    (tmp_path / "src/big.py").write_text("\n".join(f"value_{i} = compute({i})" for i in range(300)))
    (tmp_path / "notes.md").write_text("Paragraph about gardens and roses.\n\nAnother one about rivers.")
    (tmp_path / "pic.png").write_bytes(b"\x89PNG pic")
    return tmp_path


def test_life_of_an_index(spark, tree):
    root, e = str(tree), HashingEmbedder(64)
    with pytest.raises(EngineError) as err:
        api.status(spark, root)
    assert err.value.code == "NO_INDEX"
    got = api.index(spark, root, embedder=e, image_embedder=e)
    assert got["files_scanned"] == 4 and got["files_indexed"] == 4 and got["chunks_created"] >= 5
    again = api.index(spark, root, embedder=e, image_embedder=e)
    assert again["files_indexed"] == 0 and again["files_skipped"] == 4 and again["chunks_created"] == 0
    s = api.status(spark, root)
    assert s["file_count"] == 4 and s["stale_file_count"] == 0 and s["by_type"]["image"] == {"files": 1, "chunks": 1} and s["model_types"] == ["hashing-bag"]

    for mode in ("keyword", "semantic", "hybrid"):
        hit = api.query(spark, "user auth token", root, mode=mode, embedder=e, image_embedder=e)
        assert hit["mode"] == mode and hit["code"][0]["file"] == "src/auth.ts" and hit["code"][0]["lines"]["start"] == 1
    assert api.query(spark, "roses", root, type="text", mode="keyword")["text"][0]["file"] == "notes.md"
    assert api.query(spark, "roses", root, dir="src", mode="keyword")["text"] == []
    assert api.query(spark, "pic", root, mode="hybrid", embedder=e, image_embedder=e)["image"][0]["file"] == "pic.png"

    (tree / "src/auth.ts").write_text("export function login() {}\n")
    os.utime(tree / "src/auth.ts", (1, 1))
    (tree / "notes.md").unlink()
    assert api.status(spark, root)["stale_file_count"] == 2
    assert api.query(spark, "roses", root, mode="keyword")["stale_file_count"] == 2
    got = api.index(spark, root, embedder=e, image_embedder=e)
    assert got["files_indexed"] == 1 and got["chunks_created"] == 1
    assert api.query(spark, "login", root, mode="keyword")["code"][0]["file"] == "src/auth.ts"
    assert api.query(spark, "user auth", root, mode="keyword")["code"] == []
    with pytest.raises(EngineError):
        api.query(spark, "roses", root, type="text")


def test_errors(spark, tmp_path):
    for code, call in (
        ("INVALID_MODE", lambda: api.query(spark, "x", str(tmp_path), mode="odd")),
        ("UNSUPPORTED_TYPE", lambda: api.index(spark, str(tmp_path), type="video")),
        ("EMPTY_DIR", lambda: api.index(spark, str(tmp_path))),
        ("NO_INDEX", lambda: api.query(spark, "x", str(tmp_path), auto_index=False)),
        ("GENERAL_ERROR", lambda: api.query(spark, "x", str(tmp_path), top_k=0)),
    ):
        with pytest.raises(EngineError) as e:
            call()
        assert e.value.code == code


def test_broken_pointer(spark, tree):
    os.makedirs(tree / ".skerry")
    (tree / ".skerry/CURRENT.json").write_text("{")
    with pytest.raises(EngineError) as e:
        api.status(spark, str(tree))
    assert e.value.code == "CORRUPT_MANIFEST"


def test_command_line(spark, tree, capsys):
    from skerry.__main__ import main

    assert main(["index", str(tree)]) == 0
    assert main(["query", "roses", "--path", str(tree), "--mode", "keyword"]) == 0
    lines = capsys.readouterr().out.strip().split("\n")
    assert json.loads(lines[-1])["text"][0]["file"] == "notes.md" and "image" not in json.loads(lines[-1])
    assert main(["query", "roses", "--path", str(tree), "--mode", "keyword", "--format", "text"]) == 0
    assert "## Text" in capsys.readouterr().out
    assert main(["status", str(tree / "src")]) == 2


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "index")
    schema = "doc_id long, text string, deleted boolean, seq long"
    for rows in ([(1, "alpha beta", False, 1), (2, "gamma", False, 2)], [(1, "delta", False, 3), (2, None, True, 4)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        incremental.follow(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "ck")).awaitTermination()
    assert [(r["doc_id"], r["term"]) for r in incremental.load(spark, out).collect()] == [(1, "delta")]
    incremental.apply_delta(spark, out, spark.createDataFrame([(9, "late", False, 1)], schema), 0)
    assert incremental.load(spark, out).count() == 1


def test_pdf_reader(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF roses")
    (tmp_path / "b.pdf").write_bytes(b"broken")

    def reader(data):
        if not data.startswith(b"%PDF"):
            raise RuntimeError("no header")
        return data.decode()

    got = api.index(spark, str(tmp_path), pdf_reader=reader)
    assert got["files_indexed"] == 2 and got["chunks_created"] == 1
    assert api.query(spark, "roses", str(tmp_path), mode="keyword")["text"][0]["file"] == "a.pdf"


def test_synthetic_files(spark):
    from skerry.operators.chunking import all_chunks
    from skerry.sources.synthetic import code_file, corpus, text_file

    assert code_file(7, 3) == code_file(7, 3) != code_file(7, 4) and len(text_file(500, 1)) == 500
    df = corpus(spark, 6, lines=400)
    assert [r["type"] for r in df.orderBy("path").collect()].count("code") == 3
    chunks = all_chunks(df).collect()
    assert {c["path"] for c in chunks} == {r["path"] for r in df.collect()} and max(c["line_end"] for c in chunks) == 400


def test_a_folder_is_ranked_by_itself(spark, tmp_path):
    """Better hits elsewhere don't take the places of a folder's own."""
    for folder, text in (("top", "needle needle needle"), ("deep", "needle among many other words that make it the weaker hit of the two by far")):
        (tmp_path / folder).mkdir()
        for i in range(20 if folder == "top" else 1):
            (tmp_path / folder / f"f{i}.md").write_text(f"{text} {folder}{i}")
    e = HashingEmbedder(64)
    api.index(spark, str(tmp_path), embedder=e)
    for mode in ("keyword", "semantic", "hybrid"):
        got = api.query(spark, "needle", str(tmp_path), top_k=1, dir="deep", mode=mode, embedder=e)
        assert [r["file"] for r in got["text"]] == ["deep/f0.md"]
    assert api.query(spark, "needle", str(tmp_path), top_k=1, dir=".", mode="keyword")["text"]


def test_models_that_are_missing(spark, tree, capsys):
    import shutil

    from skerry.__main__ import main
    from skerry.sources.store import Store

    root, e = str(tree), HashingEmbedder(64)
    api.index(spark, root, embedder=e)
    with pytest.raises(EngineError, match="needs an embedder"):
        api.query(spark, "user auth", root, mode="semantic")
    store = Store(spark, os.path.join(root, api.STORE))
    shutil.rmtree(os.path.join(store.folder, store._pointer()["snapshot"], "postings"))
    got = api.query(spark, "user auth token", root, mode="keyword", embedder=e)
    assert got["mode"] == "semantic" and "falling back" in got["warning"] and got["code"][0]["file"] == "src/auth.ts"
    with pytest.raises(EngineError, match="keyword index is missing"):
        api.query(spark, "user auth", root, mode="hybrid")
    assert main(["query", "user auth", "--path", root, "--mode", "semantic", "--model", "nowhere:x"]) == 1
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["code"] == "GENERAL_ERROR"


def test_progress(spark, tree, capsys):
    from skerry.__main__ import main

    seen, e = [], HashingEmbedder(16)
    got = api.index(spark, str(tree), embedder=e, image_embedder=e, progress=lambda *x: seen.append(x))
    assert seen[0] == ("scanned", 4, None) and ("files", 4, 4) in seen and seen[-1] == ("saved", 1, 1)
    assert max(n for stage, n, _ in seen if stage == "embedded") >= got["chunks_created"]
    assert main(["index", str(tree), "--quiet"]) == 0
    assert capsys.readouterr() == ("", "")
    assert main(["index", str(tree), "--format", "text"]) == 0
    out = capsys.readouterr()
    assert out.out.startswith("Nothing changed: 4 files scanned in ") and "scanned: 4" in out.err
    (tree / "notes.md").write_text("Other words.")
    assert main(["index", str(tree), "--format", "text", "-q"]) == 0 and capsys.readouterr().out == ""
    (tree / "notes.md").write_text("And others again.")
    assert main(["index", str(tree), "--format", "text"]) == 0
    assert capsys.readouterr().out.startswith("1 files indexed, 1 chunks created, 3 files unchanged")
    assert main(["status", str(tree), "--format", "text"]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[1] == "Files: 4 (code: 2, image: 1, text: 1)" and lines[-1] == "Stale files: 0" and lines[4].startswith("Index size: ")


def test_pooled_types(spark, tmp_path):
    """Code that ranks better takes the text's places among what is fetched."""
    for i in range(80):
        (tmp_path / f"c{i}.py").write_text("needle needle")
    (tmp_path / "t.md").write_text("needle among many other words that make it the weaker hit by far")
    api.index(spark, str(tmp_path))
    apart = api.query(spark, "needle", str(tmp_path), top_k=1, mode="keyword")
    pooled = api.query(spark, "needle", str(tmp_path), top_k=1, mode="keyword", pooled=True)
    assert apart["text"] and apart["code"] and pooled["code"] and not pooled["text"]
