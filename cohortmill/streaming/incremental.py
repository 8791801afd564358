"""Incremental jobs: every run takes what is new since the last one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from cohortmill import scale
from cohortmill.functions import context as cx
from cohortmill.streaming.store import KeyedStore

# Keyed state that may outgrow memory is kept on disk.
ON_DISK_STATE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)


def read_new(spark: SparkSession, path: str, schema, *, files_per_batch: int | None = None) -> DataFrame:
    """Stream over the parquet files of a path."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def rows_between(rows: DataFrame, column: str, start, end) -> DataFrame:
    """Batch form of one run: rows after the last end and up to the new one."""
    c = F.col(column)
    return rows.where((c > F.lit(start)) & (c <= F.lit(end)))


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, *, mode: str = "append") -> None:
    """Process everything available and stop; a failed batch is repeated by the next run."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def batch_folder(sink: str, batch_id: int) -> str:
    """Folder of one batch; a repeated batch overwrites its own folder only."""
    return f"{sink}/batch={batch_id}"


def read_sink(spark: SparkSession, sink: str, schema) -> DataFrame:
    """All batches of a sink with their number."""
    return spark.read.schema(StructType([*(f for f in schema if f.name != "batch"), StructField("batch", IntegerType())])).parquet(sink)


def incremental_docs(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Append new rows to the sink, exactly once per batch."""
    run_available(
        stream, lambda batch, n: batch.write.mode("overwrite").parquet(batch_folder(sink, n)), checkpoint
    )


def stream_ctx_concepts(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Add contexted concepts that no earlier batch has brought.

    The known ids are keyed state of the stream in RocksDB, on disk and in the checkpoint, so the sink is not read.
    """
    spark = stream.sparkSession
    spark.conf.set(*ON_DISK_STATE)
    run_available(
        stream.dropDuplicates(["ctx_id"]),
        lambda batch, n: batch.write.mode("overwrite").parquet(batch_folder(sink, n)),
        checkpoint,
    )


def refreshed(
    store: KeyedStore, n: int, rows: DataFrame, keys: DataFrame, sink: str, recompute: Callable[[DataFrame], DataFrame]
) -> None:
    """Add the rows of a batch to the store, then recompute the given keys from their whole history."""
    store.commit(n, rows)
    recompute(store.read(n, keys)).write.mode("overwrite").parquet(batch_folder(sink, n))


def stream_patient_refresh(
    stream: DataFrame, store: KeyedStore, sink: str, checkpoint: str, recompute: Callable[[DataFrame], DataFrame]
) -> None:
    """Store new annotations by patient, then recompute the patients that they touch.

    The sink holds one folder per batch; :func:`latest_per_key` gives the current state.
    """

    def write(batch: DataFrame, n: int) -> None:
        rows = scale.cut(batch)
        refreshed(store, n, rows, rows.select(store.key).distinct(), sink, recompute)

    run_available(stream, write, checkpoint)


def append_entity_anns(stream: DataFrame, sink: str, checkpoint: str, *, keys: tuple[str, ...] = ("pid", "ctx_id")) -> None:
    """Running number of annotations per entity and contexted concept, as state of the stream."""
    counts = stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    run_available(
        counts,
        lambda batch, n: batch.write.mode("overwrite").parquet(batch_folder(sink, n)),
        checkpoint,
        mode="update",
    )


def latest_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the last batch that wrote each key."""
    last = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return rows.join(last, [*keys, "batch"]).drop("batch")


def event_annotations(events: DataFrame) -> DataFrame:
    """Event rows as annotations with a contexted concept id."""
    negation = F.when(F.col("value") % 3 == 0, "Negated").otherwise("Affirmed")
    return events.withColumn("negation", negation).withColumn(
        "ctx_id", cx.ctx_id("concept", F.col("negation"), F.lit("Patient"), F.lit("Recent"))
    )
