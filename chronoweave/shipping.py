"""The package for executors that can't import it: sent once a Spark context."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_sent: set[str] = set()


def workers_find_it() -> bool:
    """Whether Python workers have the package on their path: by PYTHONPATH or as their working directory."""
    root = PACKAGE.parent
    places = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [os.getcwd()]
    return any(Path(p).resolve() == root for p in places)


def ship(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.applicationId in _sent or workers_find_it():
        return
    path = Path(tempfile.mkdtemp(prefix="chronoweave-")) / "chronoweave.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in PACKAGE.rglob("*.py"):
            z.write(f, f.relative_to(PACKAGE.parent))
    context.addPyFile(str(path))  # Spark copies it to every executor
    _sent.add(context.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with the package sent before it runs."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
