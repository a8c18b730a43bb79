"""Exactly-once appends and upserts from Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from tidemark.sources.table import Table


def batch_writer(table: Table, app_id: str, on: str | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the batch number is the transaction's, so a batch that is sent again adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        if on is None or not table.snapshot().files:
            table.append(batch, (app_id, number))
        else:
            table.merge(batch, on, txn=(app_id, number))

    return write


def stream_to(df: DataFrame, table: Table, app_id: str, checkpoint: str, on: str | None = None) -> DataStreamWriter:
    return df.writeStream.foreachBatch(batch_writer(table, app_id, on)).option("checkpointLocation", checkpoint)
