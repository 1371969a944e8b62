"""Command line: python -m skerry index|query|status."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import SparkSession

from skerry import api
from skerry.errors import EngineError


def as_text(got: dict) -> str:
    """Results in blocks by type."""
    out = []
    for kind in ("code", "text", "image"):
        if got[kind]:
            out.append(f"## {kind.capitalize()}")
            for r in got[kind]:
                lines = f":{r['lines']['start']}-{r['lines']['end']}" if "lines" in r else ""
                out.append(f"{r['file']}{lines}  {r['score']:.4f}")
                out += [f"    {x}" for x in r.get("text", "").split("\n")] if r.get("text") else []
            out.append("")
    return "\n".join(out) if out else "No results."


def size_text(n: int) -> str:
    """Bytes as B, KB, MB or GB with one decimal."""
    for unit, at in (("GB", 1024**3), ("MB", 1024**2), ("KB", 1024)):
        if n >= at:
            return f"{n / at:.1f} {unit}"
    return f"{n} B"


def index_text(got: dict) -> str:
    """One line on what an index run did."""
    secs = f"{got['duration_ms'] / 1000:.1f}s"
    if not (got["files_indexed"] or got["chunks_created"] or got["chunks_removed"]):
        return f"Nothing changed: {got['files_scanned']} files scanned in {secs}"
    done = [f"{got['files_indexed']} files indexed", f"{got['chunks_created']} chunks created"]
    done += [f"{got[k]} {what}" for k, what in (("files_skipped", "files unchanged"), ("chunks_removed", "chunks removed")) if got[k]]
    return f"{', '.join(done)} in {secs} ({got['chunks_reused']} chunks reused, {got['storage_dir']})"


def status_text(got: dict) -> str:
    files = ", ".join(f"{kind}: {x['files']}" for kind, x in sorted(got["by_type"].items()))
    return "\n".join(
        (
            f"Index: {got['storage_path']}", f"Files: {got['file_count']} ({files})", f"Chunks: {got['chunk_count']}", f"Last indexed: {got['last_indexed'] or 'never'}",
            f"Index size: {size_text(got['index_size_bytes'])}", f"Stale files: {got['stale_file_count']}",
        )
    )


def show(stage: str, done: int, total: int | None) -> None:
    print(f"{stage}: {done}" + (f" of {total}" if total is not None else ""), file=sys.stderr, flush=True)


def _model(name: str | None):
    """The embedder that ``module:name`` names."""
    if name is None:
        return None
    module, _, attr = name.partition(":")
    try:
        got = getattr(importlib.import_module(module), attr)
    except (ImportError, AttributeError) as e:
        raise EngineError("GENERAL_ERROR", f"No embedder {name}: {e}", "Name it as module:name") from e
    return got() if isinstance(got, type) or not hasattr(got, "embed") else got


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="skerry")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index")
    i.add_argument("path", nargs="?", default=".")
    i.add_argument("--no-ignore", action="store_true")
    i.add_argument("--type")
    i.add_argument("--clear", action="store_true")
    i.add_argument("-q", "--quiet", action="store_true", help="no progress and no report")
    q = sub.add_parser("query")
    q.add_argument("text")
    q.add_argument("--path", default=".")
    q.add_argument("-k", "--top-k", type=int, default=10)
    q.add_argument("--dir")
    q.add_argument("--threshold", type=float)
    q.add_argument("--type")
    q.add_argument("--mode", default="hybrid")
    q.add_argument("--no-auto-index", action="store_true")
    q.add_argument("--pooled", action="store_true", help="rank code and text together before they are parted")
    s = sub.add_parser("status")
    s.add_argument("path", nargs="?", default=".")
    s.add_argument("--no-ignore", action="store_true")
    for x in (i, q):
        x.add_argument("--model", help="module:name of an embedder of texts, or of a function that makes one")
        x.add_argument("--clip-model", help="the same for images")
    for x in (i, q, s):
        x.add_argument("--format", choices=("json", "text"), default="json")
    a = p.parse_args(args)
    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if a.command == "index":
            got = api.index(spark, a.path, not a.no_ignore, a.type, a.clear, _model(a.model), _model(a.clip_model), progress=None if a.quiet else show)
        elif a.command == "query":
            got = api.query(spark, a.text, a.path, a.top_k, a.dir, a.threshold, a.type, a.mode, not a.no_auto_index, _model(a.model), _model(a.clip_model), a.pooled)
            if a.format == "json":
                got = {k: v for k, v in got.items() if k not in ("code", "text", "image") or v}
        else:
            got = api.status(spark, a.path, not a.no_ignore)
        if a.format == "text":
            said = {"query": as_text, "index": index_text, "status": status_text}[a.command](got)
            if a.command != "index" or not a.quiet:
                print(said)
        elif a.command != "index" or not a.quiet:
            print(json.dumps(got, ensure_ascii=False))
        return 0
    except EngineError as e:
        print(json.dumps(e.as_dict()) if a.format == "json" else f"{e.code}: {e.message}\n{e.suggestion}".strip(), file=sys.stderr if a.format == "text" else sys.stdout)
        return 2 if a.command == "status" and e.code == "NO_INDEX" else 1


if __name__ == "__main__":
    sys.exit(main())
