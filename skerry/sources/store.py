"""An index as Parquet tables that grow by saves, and a pointer to the last one.

A save writes what it adds as partitions of its own number, and the keys whose
earlier rows no longer count; a reader puts the two together. So a save costs
what changed, whatever the index holds, and a reader of an earlier save still
has all its files. After ``COMPACT`` saves the rows that count are written
together and reading starts from them. Everything goes through Spark's readers
and writers and Hadoop's file system, so the folder may be remote.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 2
#: Saves from which the next one writes the tables together.
COMPACT = 8

SCHEMAS = {
    "manifest": "path string, type string, size long, mtime double, hash string, n_chunks long",
    "chunks": "id string, path string, type string, chunk_index int, line_start int, line_end int, token_count int, text_hash string, chunk_text string",
    "postings": "id string, path string, term string, tf long",
    "vectors": "id string, path string, type string, model_id string, text_hash string, embedding array<float>",
}


class Files:
    """Hadoop's file system below a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._conf, self.folder = spark._jsc.hadoopConfiguration(), folder
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str) -> list[str]:
        return [x.getPath().getName() for x in self._fs.listStatus(self._path(name))] if self.exists(name) else []

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._path(name), True)

    def size(self) -> int:
        """Bytes below the folder; 0 if there is none."""
        return self._fs.getContentSummary(self._path("")).getLength() if self.exists() else 0

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Puts a file in place of another in one step."""
        tmp = self._path(f".{name}.new")
        out = self._fs.create(tmp, True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        over = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = over
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        context.rename(self._fs.makeQualified(tmp), self._fs.makeQualified(self._path(name)), options)


class Deltas:
    """Tables by name that share a key column; of a key the rows of the last save that named it count."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str], key: str):
        self.spark, self.folder, self.schemas, self.key = spark, folder, schemas, key
        self.files = Files(spark, folder)

    def _pointer(self) -> dict | None:
        try:
            got = json.loads(self.files.read("CURRENT.json"))
            return got if got["version"] == VERSION and self.files.exists(got["snapshot"]) else None
        except Exception:  # a file that isn't there or can't be read, whatever the file system calls it
            return None

    @property
    def exists(self) -> bool:
        return self._pointer() is not None

    @property
    def number(self) -> int:
        """Of the last save; 0 before any."""
        p = self._pointer()
        return p["number"] if p else 0

    @property
    def broken(self) -> bool:
        """A pointer is there but names no readable index of this version."""
        return self.files.exists("CURRENT.json") and not self.exists

    @property
    def saved_at(self) -> float | None:
        p = self._pointer()
        return p["at"] if p else None

    def _read(self, name: str, schema: str, first: int, last: int) -> DataFrame:
        rows = self.spark.read.schema(f"{schema}, save int").parquet(f"{self.folder}/data/{name}") if self.files.exists(f"data/{name}") else self.spark.createDataFrame([], f"{schema}, save int")
        return rows.filter(F.col("save").between(first, last))

    def _key(self, name: str) -> str:
        return next(c.strip() for c in self.schemas[name].split(", ") if c.split()[0] == self.key)

    def load(self, name: str) -> DataFrame:
        """The rows that count after the last save; none if there is no save, or one of another version."""
        p = self._pointer()
        if p is None:
            return self.spark.createDataFrame([], self.schemas[name])
        rows = self._read(name, self.schemas[name], p["base"], p["number"])
        if p["number"] > p["base"]:
            gone = self._read(f"{name}_gone", self._key(name), p["base"] + 1, p["number"]).groupBy(self.key).agg(F.max("save").alias("_gone"))
            rows = rows.join(gone, self.key, "left").filter(F.col("_gone").isNull() | (F.col("_gone") <= F.col("save")))
        return rows.select(*[c.split()[0] for c in self.schemas[name].split(", ")])

    def has(self, name: str) -> bool:
        """Whether the index holds the table."""
        p = self._pointer()
        return p is not None and self.files.exists(f"{p['snapshot']}/{name}")

    def _write(self, df: DataFrame, name: str, number: int) -> None:
        # a folder of its own: a write into the table's folder would make Spark read again what is cached from earlier saves
        df.write.mode("overwrite").parquet(f"{self.folder}/data/{name}/save={number}")

    def save(self, added: dict[str, DataFrame], gone: dict[str, DataFrame], at: float, number: int | None = None) -> None:
        """Adds rows to each table after dropping those of the keys in ``gone``; a save that fails changes nothing.

        ``number`` is greater than the last save's; the next one without it.
        """
        old = self._pointer()
        last, base = (old["number"], old["base"]) if old else (0, 0)
        number = last + 1 if number is None else number
        whole = old is None or sum(base < int(x.removeprefix("save=")) <= last for t in self.schemas for x in self.files.names(f"data/{t}_gone") if x.startswith("save=")) >= COMPACT * len(self.schemas)
        writes = []
        for t in self.schemas:
            rows = added[t].select(*[c.split()[0] for c in self.schemas[t].split(", ")])
            keys = gone[t].select(self.key).distinct()
            if whole:
                writes.append((self.load(t).join(keys, self.key, "left_anti").unionByName(rows) if old else rows, t))
            else:
                writes += [(rows, t), (keys, f"{t}_gone")]
        # side by side: a small save is a few small jobs, which wait for one another more than they work
        with ThreadPoolExecutor(len(writes)) as pool:
            for done in [pool.submit(self._write, df, name, number) for df, name in writes]:
                done.result()
        self.files.replace("CURRENT.json", json.dumps({"version": VERSION, "snapshot": "data", "at": at, "number": number, "base": number if whole else base}))
        if whole and old:  # readers of the saves since the last base still have theirs
            for t in self.schemas:
                for table in (t, f"{t}_gone"):
                    for x in self.files.names(f"data/{table}"):
                        if x.startswith("save=") and int(x.removeprefix("save=")) < base:
                            self.files.delete(f"data/{table}/{x}")

    def clear(self) -> None:
        self.files.delete()

    def size(self) -> int:
        return self.files.size()


class Store(Deltas):
    """The index of a folder of files, by path."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder, SCHEMAS, "path")
