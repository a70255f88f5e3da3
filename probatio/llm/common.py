"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_DIGITS = 3  # hexadecimal digits: 4096 slices of each group


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    A purely local session without the setting gets a temporary folder; any other
    session without it is an error, since executors would not see each other's files.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="probatio-llm-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def stage(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """Write an intermediate to the shared folder and read it again, in one folder for
    each value of the columns ``parts``.

    This cuts lineage: a lost executor costs the unfinished tasks of one step, and
    values that a recomputation could change (row ids, ranks) are fixed from here on.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/probatio-llm/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*parts).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def put_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Write a small file into the shared folder and have Spark hand it to every executor,
    also to those that join later; tasks find it by ``SparkFiles.get(name)``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/probatio-llm/{name}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(path)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where ``df`` has columns called so."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def join_entries(rows: DataFrame, entries: DataFrame, key: str, count: str) -> DataFrame:
    """Join rows with a table that has one row per key and in ``count`` how many rows have
    the key.

    Keys of more than 1/1000 of all rows, of which there are fewer than 1000, are broadcast
    with their entries; only rows of the other keys are shuffled.
    """
    total = entries.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    often = F.col(count) * 1000 > F.lit(total)
    hot = F.broadcast(entries.where(often))
    cold = rows.join(F.broadcast(entries.where(often).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(cold.join(entries.where(~often), key))


def order_key(doc_id: str = "doc_id") -> Column:
    """A fixed pseudo-random order of documents."""
    return F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def with_start(rows: DataFrame, group: list[str], order: list[str], value: Column,
               extra: DataFrame | None = None) -> DataFrame:
    """Add ``start``, the sum of ``value`` over the rows before this one in its group,
    and ``bucket`` and ``ordinal``, which together with the group identify a row.

    ``order`` begins with a hexadecimal ``order_key``; its first digits cut a group
    into 4096 slices, so a group with a third of all rows is still many small windows.
    ``extra`` holds more columns of each group.  Group columns must not be NULL.
    """
    rows = rows.withColumn("bucket", F.substring(order[0], 1, BUCKET_DIGITS))
    sums = rows.groupBy(*group, "bucket").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sums.select(*group, "bucket", F.coalesce(
        F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    if extra is not None:
        offsets = offsets.join(extra, group)
    inside = Window.partitionBy(*group, "bucket").orderBy(*order)
    return (rows.join(offsets, [*group, "bucket"])
            .withColumn("ordinal", F.row_number().over(inside))
            .withColumn("start", F.col("_offset") + F.coalesce(F.sum(value).over(
                inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .drop("_offset"))
