"""Helpers that keep plans safe when one key holds a large part of the rows."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A side is broadcast only after it was counted and found within both bounds.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20

SETTING = "spark.checkpoint.dir"
# Paths of the cut tables by application.
_CUTS: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for cut lineage and job tables, as named by ``spark.checkpoint.dir``.

    A cluster must name it. A local session that does not gets a folder of its own, which goes when the process ends.
    """
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{SETTING} must name a shared folder on a cluster")
    folder = os.path.join(tempfile.gettempdir(), f"cohortmill-{spark.sparkContext.applicationId}")
    spark.conf.set(SETTING, folder)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def drop_cuts(spark: SparkSession) -> None:
    """Delete the tables that this session has cut so far; frames that read them must be done."""
    for path in _CUTS.pop(spark.sparkContext.applicationId, []):
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def job_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the frame as a table in the shared folder and read it back.

    This cuts the lineage with data that survives the loss of executors, and the file
    statistics give the planner the true size for its broadcast decisions.
    """
    spark = df.sparkSession
    path = job_folder(spark, "cut")
    _CUTS.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_small_input(df: DataFrame, *, by_file: bool = False) -> DataFrame:
    """Spread rows over the cores if the input has fewer splits than there are cores.

    Heavy row-local work on a few large rows would otherwise run on few cores. Input with enough
    splits, which is any large input, is left as it is and not shuffled. With ``by_file`` a split counts only as far as
    there are files: the splits of a file with one row group are empty but for one.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits >= cores and not (by_file and len(df.inputFiles()) < cores):
        return df
    return df.repartition(max(cores, splits))


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether rows and bytes are within the broadcast bounds; looks at one row more than allowed at most."""
    size = F.length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))
    found = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).first()
    return found.n <= max_rows and (found.bytes or 0) <= max_bytes


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint if the counted size is within the bounds, else the frame as it is.

    Without the hint Spark plans a shuffled join, which adaptive execution may still turn
    into a broadcast by measured size or split where it is skewed.
    """
    return F.broadcast(df) if is_small(df, max_rows) else df


def skew_join(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Join rows to a side with few rows per key, by a shuffle that adaptive execution splits where a left key is hot.

    ``session.RUNTIME_SETTINGS`` turn the split on. The left side runs once, and no right row, which may hold a whole text, is
    broadcast. The right side must not be an aggregate on the same key: write it first (:func:`cut`).
    """
    return left.join(right, [on] if isinstance(on, str) else list(on), how)


def numbered(
    df: DataFrame,
    key: str,
    order: Sequence[Column],
    bucket: Column,
    name: str = "no",
) -> DataFrame:
    """Running number from 1 per key, for keys of any size.

    ``bucket`` must grow with the first order column. Rows are numbered inside
    (key, bucket) and moved on by the rows of the buckets before, so that no task has to
    sort a whole key.
    """
    rows = df.withColumn("_bucket", bucket)
    ahead = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    moves = sizes.select(
        F.col(key).alias("_key"),
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_ahead"),
    )
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    rows = rows.withColumn("_no", F.row_number().over(inside))
    joined = rows.join(moves, (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn(name, F.col("_no") + F.col("_ahead")).drop(
        "_bucket", "_key", "_b", "_ahead", "_no"
    )


def neighbours(
    df: DataFrame,
    key: str,
    order: str,
    value: str,
    bucket: Column,
    prev_name: str = "prev",
    next_name: str = "next",
) -> DataFrame:
    """Value of the row before and after per key, for keys of any size.

    Inside (key, bucket) this is a plain lag/lead. At the bucket edges the last value of
    the bucket before and the first of the bucket after are joined in.
    """
    rows = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(key, "_bucket").orderBy(order)
    across = Window.partitionBy("_key").orderBy("_b")
    edges = (
        rows.groupBy(F.col(key).alias("_key"), F.col("_bucket").alias("_b"))
        .agg(F.min_by(value, order).alias("_first"), F.max_by(value, order).alias("_last"))
        .select(
            "_key",
            "_b",
            F.lag("_last").over(across).alias("_before"),
            F.lead("_first").over(across).alias("_after"),
        )
    )
    rows = rows.withColumn("_lag", F.lag(value).over(inside))
    rows = rows.withColumn("_lead", F.lead(value).over(inside))
    joined = rows.join(edges, (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_b")))
    return (
        joined.withColumn(prev_name, F.coalesce("_lag", "_before"))
        .withColumn(next_name, F.coalesce("_lead", "_after"))
        .drop("_bucket", "_key", "_b", "_before", "_after", "_lag", "_lead")
    )
