"""User functions over rows: the places where a job takes its own step."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame


def process_rows(rows: DataFrame, step: Callable[[DataFrame], DataFrame] | dict[str, Column]) -> DataFrame:
    """Rows after a step of the user: new columns, or any change of the frame. It stays inside the plan."""
    return rows.withColumns(step) if isinstance(step, dict) else rows.transform(step)


def process_batches(rows: DataFrame, step: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Rows after a Python function on Arrow batches, for steps that columns cannot express."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield step(batch)

    return rows.mapInPandas(run, schema)
