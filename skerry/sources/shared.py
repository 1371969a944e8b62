"""What the driver and all executors share: folders and this package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a folder of this process, on one machine alone: a cluster must name one."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if got:
        return got.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="skerry-shared-"))
    return _OWN[0]


def new_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/skerry-{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder: computed once, whatever executors are lost later."""
    spark = df.sparkSession
    to = new_dir(spark, "table")
    df.write.parquet(to)
    return spark.read.schema(df.schema).parquet(to)


def ship(spark: SparkSession) -> None:
    """Gives executors this package, for functions that name its classes; some are started without it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_skerry_core_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    to = os.path.join(tempfile.mkdtemp(prefix="skerry-zip-"), "skerry_core.zip")
    with zipfile.ZipFile(to, "w") as z:
        for d, _, names in os.walk(root):
            for x in names:
                if x.endswith(".py"):
                    full = os.path.join(d, x)
                    z.write(full, os.path.join("skerry", os.path.relpath(full, root)))
    sc.addPyFile(to)
    sc._skerry_core_shipped = True
