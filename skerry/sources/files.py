"""Files as rows: extension types, ignore rules, directory scans and reads."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skerry.functions.text import extension
from skerry.sources.shared import ship

#: File types by extension.
CODE = ".ts .tsx .js .jsx .py .go .rs .java .c .cpp .h .hpp .rb .php .swift .kt .scala .sh .bash .zsh .css .scss .html .json .yaml .yml .toml"
TEXT = ".md .mdx .txt .rst .csv .pdf"
IMAGE = ".jpg .jpeg .png .gif .webp .svg"
EXTENSIONS = {e: t for t, es in (("code", CODE), ("text", TEXT), ("image", IMAGE)) for e in es.split()}

#: The folder that an index lives in.
STORE = ".skerry"

#: What is never indexed.
EXCLUDED = """
node_modules .git dist build .next .nuxt .cache coverage .nyc_output *.lock package-lock.json yarn.lock
pnpm-lock.yaml bun.lockb .DS_Store Thumbs.db *.min.js *.min.css *.map
""".split() + [STORE]

SCAN_SCHEMA = "path string, abs_path string, type string, size long, mtime double"


def file_type(path: Column) -> Column:
    """code, text, image or null, by the lower-cased extension: a literal map, no join."""
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return table[extension(path)]


Rule = tuple[str, bool]


def compile_rules(patterns: list[str]) -> list[Rule]:
    """(regex, negated) of each line in gitignore syntax, met against a path with a trailing slash for folders."""
    out = []
    for line in patterns:
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[negated:].removeprefix("\\")
        folder = line.endswith("/")
        line = line.rstrip("/")
        rooted = "/" in line
        line = line.removeprefix("/")
        body, i = "", 0
        while i < len(line):
            c = line[i]
            if line.startswith("**/", i):
                body, i = body + "(?:[^/]+/)*", i + 3
                continue
            if line.startswith("**", i):
                body, i = body + ".*", i + 2
                continue
            if c == "*":
                body += "[^/]*"
            elif c == "?":
                body += "[^/]"
            elif c == "[" and "]" in line[i + 1 :]:
                end = line.index("]", i + 1)
                inner = line[i + 1 : end]
                body += "[" + ("^" + inner[1:] if inner[:1] == "!" else inner).replace("\\", "\\\\") + "]"
                i = end
            elif c == "\\" and i + 1 < len(line):
                i += 1
                body += re.escape(line[i])
            else:
                body += re.escape(c)
            i += 1
        out.append((("^" if rooted else "(?:^|/)") + body + ("/$" if folder else "/?$"), negated))
    return out


def is_ignored(path: str, rules: list[Rule]) -> bool:
    """Whether a file's path, or any folder above it, is ignored; the last rule that matches decides."""
    parts = path.split("/")
    for i in range(1, len(parts) + 1):
        at = "/".join(parts[:i]) + ("/" if i < len(parts) else "")
        for regex, negated in reversed(rules):
            if re.search(regex, at):
                if not negated:
                    return True
                break
    return False


def ignored(path: Column, rules: list[Rule]) -> Column:
    """``is_ignored`` as a column."""

    def verdict(at: Column) -> Column:
        return F.coalesce(*[F.when(at.rlike(r), F.lit(not n)) for r, n in reversed(rules)], F.lit(False)) if rules else F.lit(False)

    parts = F.split(path, "/")
    places = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.when(i < F.size(parts), "/").otherwise("")))
    return F.exists(places, verdict)


def _children(root: str, rel: str, rules: list[Rule], only: str | None) -> tuple[list[str], list[tuple]]:
    """(folders, files) right below a folder that aren't ignored; symlinks are left out."""
    folders, found = [], []
    with os.scandir(os.path.join(root, rel)) as entries:
        for e in entries:
            path = f"{rel}/{e.name}" if rel else e.name
            if e.is_symlink():
                continue
            if e.is_dir():
                if not is_ignored(path + "/x", rules):
                    folders.append(path)
            elif e.is_file() and not is_ignored(path, rules):
                kind = EXTENSIONS.get(os.path.splitext(e.name)[1].lower())
                if kind and only in (None, kind):
                    s = e.stat()
                    found.append((path, e.path, kind, s.st_size, s.st_mtime * 1000))
    return folders, found


class Folder(InputPartition):
    """A folder that a task lists; ``deep`` with all folders below it."""

    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.path, self.deep = path, deep


class FolderReader(DataSourceReader):
    """Deals the folders of a tree to tasks, which list them and make the rows.

    The driver opens folders from the top, level by level, until there are
    enough of them for all tasks; it keeps names of those folders alone. What
    lies below them is found by the tasks.
    """

    def __init__(self, options: dict):
        self.root, self.only = options["path"], options.get("type") or None
        self.enough = int(options.get("tasks", "64"))
        self.rules: list[Rule] = [(r, n) for r, n in json.loads(options["rules"])]

    def partitions(self) -> list[Folder]:
        opened, level = [], [""]
        while level and len(level) + len(opened) < self.enough:
            opened += level
            level = [x for f in level for x in _children(self.root, f, self.rules, self.only)[0]]
        # opened folders give their own files, the last level all that lies below
        return [Folder(f, False) for f in opened] + [Folder(f, True) for f in level]

    def read(self, partition: Folder) -> Iterator[tuple]:
        stack = [partition.path]
        while stack:
            folders, found = _children(self.root, stack.pop(), self.rules, self.only)
            yield from found
            if partition.deep:
                stack += folders


class FolderSource(DataSource):
    """Spark's ``skerry_folder`` format: the files of a folder tree as rows."""

    @classmethod
    def name(cls) -> str:
        return "skerry_folder"

    def schema(self) -> str:
        return SCAN_SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def scan(spark: SparkSession, root: str, use_ignore_files: bool = True, type_filter: str | None = None, tasks: int | None = None) -> DataFrame:
    """One row for each file below a folder that all executors see: hidden names included, symlinks and ignored paths left out.

    Tasks list the folders, some ``tasks`` of them or more (twice the cores without it);
    the driver opens the top of the tree alone.
    """
    root = os.path.abspath(root)
    lines = list(EXCLUDED)
    for name in (".gitignore", ".cursorignore") if use_ignore_files else ():
        full = os.path.join(root, name)
        if os.path.isfile(full):
            with open(full, encoding="utf-8", errors="replace") as f:
                lines += f.read().splitlines()
    ship(spark)
    spark.dataSource.register(FolderSource)
    options = {"rules": json.dumps(compile_rules(lines)), "type": type_filter or "", "tasks": str(tasks or 2 * spark.sparkContext.defaultParallelism)}
    return spark.read.format("skerry_folder").options(**options).load(root)


def read_contents(files: DataFrame) -> DataFrame:
    """Adds ``content`` (bytes), read on the executors."""
    def run(it):
        import pandas as pd

        for df in it:
            data = []
            for p in df["abs_path"]:
                with open(p, "rb") as f:
                    data.append(f.read())
            yield df.assign(content=pd.Series(data, index=df.index, dtype=object))

    return files.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema.fields) + ", content binary")
