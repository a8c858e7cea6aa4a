"""Session set-up and materialisation into the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, and the master is local, one of our own."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        known = spark.conf.get("chronoweave.scratch", None)
    if not known:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="chronoweave-")
        atexit.register(shutil.rmtree, known.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("chronoweave.scratch", known)
    return known.rstrip("/")


_written: dict[str, list[str]] = {}


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts the lineage, and survives the loss of executors since the files are in
    the folder that all of them share. clear() deletes what a session wrote, drop() one table that nothing reads any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cw-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_at = path
    return out


def _delete(spark: SparkSession, address: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(address)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(df: DataFrame) -> None:
    """Delete the files of a frame that materialize returned; no later read of it may follow."""
    if at := getattr(df, "_table_at", None):
        _delete(df.sparkSession, at)
        _written[df.sparkSession.sparkContext.applicationId].remove(at)


def clear(spark: SparkSession) -> int:
    """Delete all tables that materialize wrote in this application, once their results were used; gives their number."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def numbered(df: DataFrame, by: list[str], into: str = "n", start: int = 1) -> DataFrame:
    """df with the places of its rows in the order of ``by``, from ``start``: sorted range partitions, each moved on by the rows before it. No row passes through a single task."""
    placed = materialize(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    before, total = [], start
    for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("c")).orderBy("p").collect():  # a row a partition
        before += [F.lit(r["p"]), F.lit(total)]
        total += r["c"]
    offset = F.create_map(*before)[part] if before else F.lit(start)
    return placed.withColumn(into, (offset + F.col("__at").bitwiseAND((1 << 33) - 1)).cast("bigint")).drop("__at")
