"""Processing of new documents: tag, judge, store, refresh the patients that they touch, and log the batch last.

A run goes on behind the high-water mark of the last batch in the log. A batch that fails anywhere leaves no entry there, so the next run
takes the same documents again; every step of it writes folders of the batch only, which the repetition replaces.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortmill import scale
from cohortmill.streaming import incremental
from cohortmill.streaming.store import KeyedStore

LOGGED = "batch long, mark string, docs long, annotations long, patients long"


@dataclass(frozen=True)
class CommitLog:
    """One small file per finished batch with its high-water mark and counts."""

    spark: SparkSession
    path: str

    def entries(self) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], LOGGED)
        return self.spark.read.schema(LOGGED).parquet(f"{self.path}/*")

    def last(self) -> tuple[int, str | None]:
        """Number and mark of the last finished batch, -1 and none before the first."""
        row = self.entries().agg(F.max("batch"), F.max_by("mark", "batch")).first()
        return (-1, None) if row[0] is None else (row[0], row[1])

    def add(self, entry: tuple) -> None:
        rows = self.spark.createDataFrame([entry], LOGGED)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{entry[0]:010d}")


@dataclass(frozen=True)
class Processing:
    """What happens to a batch of documents.

    ``annotate(docs)`` gives mentions with their ``doc_id``, ``judge(mentions, docs)`` their verdicts, ``summarise(annotations)`` one row or
    more per ``key``. Judged mentions are stored with the key of their document; ``mark`` is the column of the documents that grows.
    """

    path: str
    annotate: Callable[[DataFrame], DataFrame]
    judge: Callable[[DataFrame, DataFrame], DataFrame]
    summarise: Callable[[DataFrame], DataFrame]
    schema: StructType
    key: str = "pid"
    mark: str = "doc_id"
    part_rows: int = 1_000_000
    #: Called with the number of a batch before it is logged; a hook for checks, which may refuse the batch.
    before_log: Callable[[int], None] | None = None

    def store(self, spark: SparkSession) -> KeyedStore:
        return KeyedStore(spark, f"{self.path}/annotations", self.schema, self.key, self.part_rows)

    def log(self, spark: SparkSession) -> CommitLog:
        return CommitLog(spark, f"{self.path}/log")

    def batch(self, docs: DataFrame, n: int) -> None:
        """One batch: annotate, judge, store, refresh, log. A batch that is in the log is done already."""
        spark = docs.sparkSession
        log = self.log(spark)
        if n <= log.last()[0]:
            return
        # a batch may be one file, which few tasks read, and tagging is heavy
        docs = scale.cut(docs.repartition(max(docs.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)))
        # judged mentions are read by the store only
        judged = self.judge(scale.cut(self.annotate(docs)), docs)
        owners = docs.select("doc_id", self.key)
        rows = scale.skew_join(judged.drop(self.key), owners, "doc_id").select(*self.schema.names)
        keys = scale.cut(owners.select(self.key).distinct())
        store = self.store(spark)
        incremental.refreshed(store, n, rows, keys, f"{self.path}/summary", self.summarise)
        if self.before_log:
            self.before_log(n)
        size = docs.agg(F.max(self.mark).cast("string"), F.count(F.lit(1))).first()
        before = store.listed(n - 1).agg(F.sum("rows")).first()[0] or 0
        after = store.listed(n).agg(F.sum("rows")).first()[0] or 0
        log.add((n, size[0], size[1], after - before, keys.count()))

    def stream(self, docs: DataFrame, checkpoint: str) -> None:
        """Everything that a stream of documents has, batch by batch."""
        incremental.run_available(docs, self.batch, checkpoint)

    def pending(self, docs: DataFrame) -> DataFrame:
        """Documents of a table behind the last mark."""
        mark = self.log(docs.sparkSession).last()[1]
        return docs if mark is None else docs.where(F.col(self.mark) > F.lit(mark).cast(docs.schema[self.mark].dataType))

    def run(self, docs: DataFrame) -> bool:
        """One batch of all documents behind the last mark; whether there were any."""
        new = self.pending(docs)
        if new.isEmpty():
            return False
        self.batch(new, self.log(docs.sparkSession).last()[0] + 1)
        return True

    def summary(self, spark: SparkSession) -> DataFrame:
        """Current summary of all keys."""
        rows = spark.read.parquet(f"{self.path}/summary")
        return incremental.latest_per_key(rows, [self.key])
