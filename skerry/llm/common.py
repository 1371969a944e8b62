"""Shared plumbing: the shared folder, table reads, shipping code, ordered partitions."""

from __future__ import annotations

import contextlib
import ctypes
import math
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []
_TABLES: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Gives executors this package, for runs whose PYTHONPATH doesn't hold it."""
    sc = spark.sparkContext
    if getattr(sc, "_skerry_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(root):
        to = os.path.join(tempfile.mkdtemp(prefix="skerry-zip-"), "skerry_code.zip")
        with zipfile.ZipFile(to, "w") as z:
            for d, _, names in os.walk(root):
                for x in names:
                    if x.endswith(".py"):
                        full = os.path.join(d, x)
                        z.write(full, os.path.join("skerry", os.path.relpath(full, root)))
        sc.addPyFile(to)
    sc._skerry_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """A URI of a folder that the driver and all executors share.

    ``spark.checkpoint.dir`` if it is set; otherwise a folder of this process,
    on one machine alone: a cluster must name one.
    """
    sc = spark.sparkContext
    got = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not got:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _OWN_DIR:
            _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="skerry-shared-"))
        got = _OWN_DIR[0]
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(got)
    return got if "://" in got else "file://" + os.path.abspath(got.removeprefix("file:"))


def new_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/skerry-{what}-{uuid.uuid4().hex}"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: a table in the shared folder, read back.

    Unlike ``checkpoint()`` it computes its rows once, and executors that are
    lost later take nothing with them.
    """
    spark = df.sparkSession
    to = new_dir(spark, "table")
    df.write.parquet(to)
    _TABLES.append(to)
    return spark.read.schema(df.schema).parquet(to)


def tables_made() -> int:
    """Tables that ``cut`` has made in this process so far."""
    return len(_TABLES)


def drop_tables(spark: SparkSession, since: int, but_last: bool = False) -> None:
    """Deletes what ``cut`` has made since, all but its last table if told so: for a job that has written what came of them."""
    end = len(_TABLES) - 1 if but_last else len(_TABLES)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for uri in _TABLES[since:end]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(conf).delete(path, True)
    del _TABLES[since:end]


#: Rows of numbers of one file at least, where a table has so many.
FILE_ROWS = 100_000


def in_files(df: DataFrame, most_rows: int) -> DataFrame:
    """``df``, which has ``most_rows`` short rows at most, in no more partitions than make sense as files: opening one costs more than some rows."""
    return df.coalesce(max(1, min(n_parts(df.sparkSession), -(-most_rows // FILE_ROWS))))


def numbered(docs: DataFrame) -> DataFrame:
    """The same rows with columns named by their place, c0, c1 and so on: no name of an operator's own clashes with them."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def place(docs: DataFrame, name: str) -> str:
    """What ``numbered`` calls a column."""
    return f"c{docs.columns.index(name)}"


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a ``numbered`` table; maps, which Spark doesn't hash, by their JSON."""
    return F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in docs.dtypes])


def n_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: Rows of one key from which it is looked up apart, and the number of such keys at most (the most frequent).
OFTEN, OFTEN_KEYS = 50_000, 10_000


def look_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns that ``table`` (distinct keys) has for their ``key``, null where it has none.

    A key may hold any share of the rows: the most frequent, OFTEN_KEYS at
    most, are broadcast with their values, so that their rows stay where they
    are; a shuffle gathers no more of another key than OFTEN or rows / OFTEN_KEYS.
    """
    often = cut(rows.groupBy(key).count().filter((F.col("count") > OFTEN) & F.col(key).isNotNull()).orderBy(F.desc("count"), key).limit(OFTEN_KEYS).select(key))
    columns = [*rows.columns, *[c for c in table.columns if c != key]]
    if often.isEmpty():
        return rows.join(table, key, "left").select(columns)
    few = F.broadcast(often)
    hot = cut(table.join(few, key, "left_semi"))
    apart = rows.join(few, key, "left_semi").join(F.broadcast(hot), key, "left").select(columns)
    return apart.unionByName(rows.join(few, key, "left_anti").join(table, key, "left").select(columns))


def by_id_order(df: DataFrame, key: str, ahead: bool = False) -> DataFrame:
    """Rows of ``df`` in ascending ``key`` (a long; null first) over numbered partitions.

    Adds ``_part`` and, with ``ahead``, ``_ahead``: a copy of each partition's
    first row (all rows of its key) also stands at the end of the partition
    before it, so that a row and its successor always meet in one partition;
    the first key's rows are also at the very end of the last partition. The
    bounds are quantiles of the key column alone: one number a partition comes
    to the driver, never rows.
    """
    spark = df.sparkSession
    n = n_parts(spark)
    probe = df.select(F.col(key).cast("long").alias("k")).agg(
        F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], F.lit(10 * n + 1000)).alias("q"), F.min("k").alias("lo"), F.count(F.lit(1)).alias("n"), F.count("k").alias("n_keys")
    ).first()
    if probe is None or probe["lo"] is None:
        edges = []
    else:
        edges = sorted({int(x) for x in probe["q"]} | {int(probe["lo"])})
    k = F.col(key).cast("long")
    low = edges[1:]
    part = _rank_in(k, low) if low else F.lit(0)
    out = df.withColumn("_part", F.when(k.isNull(), F.lit(0)).otherwise(part).cast("int"))
    parts = len(low) + 1
    if ahead:
        first = F.col("_part") - 1
        lowest = k.isNull() if probe["n"] > probe["n_keys"] else k == F.lit(edges[0]) if edges else F.lit(False)
        here = F.struct(F.col("_part").alias("p"), F.lit(0).alias("a"))
        back = F.struct(first.cast("int").alias("p"), F.lit(1).alias("a"))
        wrap = F.struct(F.lit(parts - 1).alias("p"), F.lit(2).alias("a"))
        is_edge = k.isin([int(x) for x in low]) if low else F.lit(False)
        places = F.when(F.coalesce(is_edge, F.lit(False)), F.array(here, back)).when(F.coalesce(lowest, F.lit(False)), F.array(here, wrap)).otherwise(F.array(here))
        out = out.withColumn("_at", F.explode(places)).withColumn("_part", F.col("_at.p")).withColumn("_ahead", F.col("_at.a")).drop("_at")
    return out.repartitionById(parts, F.col("_part"))


def _rank_in(k, edges: list[int]):
    """How many of ``edges`` (ascending) are at most ``k``: first among every s-th, then within one step of s."""
    s = max(1, math.isqrt(len(edges)))
    array = lambda xs: F.lit(xs).cast("array<bigint>")
    upto = lambda xs: F.size(F.filter(xs, lambda e: e <= k))
    steps = upto(array(edges[::s]))
    at = lambda c: F.when(c > 0, (c - 1) * s + upto(F.slice(array(edges), (c - 1) * s + 1, s))).otherwise(0)
    return F.element_at(F.transform(F.array(steps), at), 1)


def give_back() -> None:
    """Returns memory that a worker has freed to the system, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def strings(col: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings; null counts as empty."""
    return [x if x is not None else "" for x in col.to_pylist()]


def batches_of(it: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each holds about ``most`` bytes of ``column`` (one row at least)."""
    import pyarrow.compute as pc

    for b in it:
        if not b.num_rows:
            continue
        i = b.schema.get_field_index(column)
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(i)), 0).to_numpy(zero_copy_only=False).astype("int64"))
        at = 0
        while at < b.num_rows:
            base = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, base + most, side="right")))
            yield b.slice(at, end - at)
            at = end


def spread(first: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indexes first[i], first[i]+1, ... of lens[i] items each, for all i in a row."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.arange(total, dtype=np.int64)
    out += np.repeat(first - (np.cumsum(lens) - lens), lens)
    return out
