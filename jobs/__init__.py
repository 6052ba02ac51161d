"""Runnable jobs over the given tables; each holds its work in run(spark, ...) and a command line."""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

LOG = logging.getLogger("jobs")


def settings(file: str, path: str | None = None) -> dict:
    """The settings beside a job's file, or those at path; keys that the job doesn't know raise."""
    own = json.loads(Path(file).with_suffix(".json").read_text())
    if path is None:
        return own
    given = json.loads(Path(path).read_text())
    if unknown := sorted(set(given) - set(own)):
        raise ValueError(f"{path} has settings that are none: {', '.join(unknown)}")
    return own | given


def arguments(doc: str, *paths: str) -> argparse.Namespace:
    """Plain path arguments, all needed, and an optional --config."""
    p = argparse.ArgumentParser(description=doc.splitlines()[0])
    for name in paths:
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return p.parse_args()


def session(name: str):
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
