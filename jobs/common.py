"""What the jobs share: config files, a command line, a log."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from pyspark.sql import SparkSession

LOG = logging.getLogger("skerry.jobs")


def read_config(spark: SparkSession, path: str, known: dict) -> dict:
    """``known`` with what the JSON file at ``path``, which may be remote, says instead; a name that isn't known is an error."""
    got = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    if more := set(got) - set(known):
        raise ValueError(f"{path}: unknown settings {', '.join(sorted(more))}")
    return {**known, **got}


def command_line(name: str, about: str, paths: tuple[str, ...], work) -> int:
    """Runs ``work(session, paths by name, path of the config or None)``: the only place that makes and stops a session."""
    p = argparse.ArgumentParser(prog=name, description=about)
    for x in paths:
        p.add_argument(f"--{x}", required=True)
    p.add_argument("--config", help="JSON file; settings that it doesn't name keep their defaults")
    a = vars(p.parse_args())
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        work(spark, {x: a[x] for x in paths}, a["config"])
        return 0
    finally:
        spark.stop()
