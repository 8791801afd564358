"""Helpers of the training-data operators: reading tables, Arrow column functions, cut tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

# A batch of rows handed to Python holds at most about so many bytes or rows.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 1000

# The settings that the plans of this subpackage rely on; all of them can change at run time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
    "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
}


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings of this subpackage."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; whatever else a table holds is not read."""
    return df.select(*names)


def map_arrow(
    df: DataFrame,
    reads: Sequence[str],
    fields: Sequence[StructField],
    func: Callable[..., Sequence],
    keep: Sequence[str] = (),
) -> DataFrame:
    """Add columns worked out in Arrow batches.

    ``func`` gets the columns ``reads`` as Arrow arrays and returns one list or array per
    field. The result has the columns ``keep`` (without those that a field replaces) and
    the fields. Rows neither move nor change their number.
    """
    names = [f.name for f in fields]
    kept = [c for c in keep if c not in names]
    schema = StructType([*(df.schema[c] for c in kept), *fields])
    types = [to_arrow_type(f.dataType) for f in fields]
    frame = df.select(*dict.fromkeys([*kept, *reads]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = func(*(batch.column(c) for c in reads))
            new = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], names=[*kept, *names])

    return frame.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
