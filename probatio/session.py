"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "probatio",
                  shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A session with adaptive execution on and timestamps in UTC.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: AQE coalesces
    from the configured maximum and splits skewed join partitions.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **extra,
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    Without the setting a purely local session gets a temporary folder; any other session
    is refused, since its executors would not see each other's files.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="probatio-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def shuffled(df: DataFrame) -> DataFrame:
    """One side of a join on keys, for rows that grow with the data: never broadcast whole.

    Spark guesses what a table holds from the bytes of its files.  Columns that repeat are
    compressed to a fraction, and texts and lists made from them are not counted, so a table
    of a few MB may be GBs on the driver.
    """
    return df.hint("merge")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise an intermediate that several branches read, as a table in the shared
    folder, so a lost executor costs tasks and not the whole chain."""
    path = f"{shared_folder(df.sparkSession)}/probatio/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
