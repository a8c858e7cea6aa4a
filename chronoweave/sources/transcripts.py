"""Transcript files: discovery, and incremental reading by byte offset."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED_PROJECTS = ("-private-tmp", "-tmp-", "-var-")
BLOCK_BYTES = 8 << 20


def discover(spark: SparkSession, root: str, since: dt.datetime | None = None, recursive: bool = False, pattern: str = "*.jsonl") -> DataFrame:
    """(path, mtime, length) of the transcript files below root, newest first; folders of scratch projects are left out.

    Empty files aren't listed. One level of project folders is read, or with ``recursive`` the whole tree. Only listings are read, no contents.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if since is not None:
        reader = reader.option("modifiedAfter", since.strftime("%Y-%m-%dT%H:%M:%S"))
    files = reader.load(root if recursive else f"{root}/*").select("path", F.col("modificationTime").alias("mtime"), "length")
    project = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    skipped = F.lit(False)
    for p in SKIPPED_PROJECTS:
        skipped = skipped | F.startswith(project, F.lit(p))
    return files.where(~skipped).orderBy(F.desc("mtime"), "path")


def due(files: DataFrame, state: DataFrame, now: float) -> DataFrame:
    """Files with new bytes that aren't backing off: state(path, offset, error_count, last_error_ts) is the offset table."""
    wait = F.least(1800 * F.pow(F.lit(2.0), F.least("error_count", F.lit(6))), F.lit(86400.0))
    j = files.join(state, "path", "left")
    backing_off = (F.coalesce("error_count", F.lit(0)) > 0) & (F.lit(now) - F.coalesce("last_error_ts", F.lit(0.0)) < wait)
    return j.where(~backing_off & (F.col("length") > F.coalesce("offset", F.lit(0)))).select("path", F.coalesce("offset", F.lit(0)).cast("bigint").alias("offset"), "length")


def read_new(files: DataFrame) -> DataFrame:
    """(path, line_offset, next_offset, value): the complete lines of each file from its offset on; a last line without end waits.

    Files are spread over the executors, each is read forward from its offset, in blocks, from whatever file system its address names
    (file, object stores, Hadoop).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, offset in zip(b["path"], b["offset"]):
                rows, at, rest = [], int(offset), b""
                system, place = FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
                with system.open_input_file(place) as f:
                    f.seek(at)
                    while block := f.read(BLOCK_BYTES):
                        *lines, rest = (rest + block).split(b"\n")  # a last line without end waits
                        for line in lines:
                            rows.append((path, at, at + len(line) + 1, line.rstrip(b"\r").decode("utf-8", "replace")))
                            at += len(line) + 1
                        if len(rows) >= 10_000:
                            yield pd.DataFrame(rows, columns=["path", "line_offset", "next_offset", "value"])
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "line_offset", "next_offset", "value"])

    return files.select("path", "offset").repartition("path").mapInPandas(run, "path string, line_offset bigint, next_offset bigint, value string")


def advance(state: DataFrame, read: DataFrame) -> DataFrame:
    """The offset table after a batch: each file at the end of its last complete line, errors cleared."""
    ends = read.groupBy("path").agg(F.max("next_offset").alias("__end"))
    j = state.join(ends, "path", "full")
    done = F.col("__end").isNotNull()
    return j.select("path", F.coalesce("__end", "offset").alias("offset"), F.when(done, 0).otherwise(F.col("error_count")).alias("error_count"), F.when(~done, F.col("last_error_ts")).alias("last_error_ts"))
