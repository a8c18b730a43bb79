"""A writing session: any number of batches, one commit."""

from __future__ import annotations

from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.errors import TableExists
from tidemark.functions.partition import Transform
from tidemark.sources.formats import codec_of
from tidemark.sources.log import Snapshot
from tidemark.sources.table import Table

MODES = ("error", "errorifexists", "overwrite", "append", "ignore")


class TableWriter:
    """with TableWriter(...) as w: w.write(batch). An exception inside commits nothing."""

    def __init__(self, spark: SparkSession, path: str, mode: str = "append", profile: str = "archive", partition_by: tuple[str | Transform, ...] = (), clustering: tuple[str, ...] = (), chunk_rows: int = 0, txn: tuple[str, int] | None = None, checkpoint_interval: int = 10):
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}")
        self.spark, self.path, self.mode, self.codec, self.chunk_rows, self.txn = spark, path, mode, codec_of(profile)["compression"], chunk_rows, txn
        self.options, self.layout = {"checkpoint_interval": checkpoint_interval}, {"partition_by": partition_by, "clustering": clustering}
        self.rows: DataFrame | None = None
        self.committed: Snapshot | None = None
        self.skip = False

    def __enter__(self) -> TableWriter:
        there = Table.exists(self.spark, self.path)
        if there and self.mode in ("error", "errorifexists"):
            raise TableExists(self.path)
        self.skip = there and self.mode == "ignore"
        self.table = Table.open(self.spark, self.path, **self.options) if there else Table.create(self.spark, self.path, **self.layout, **self.options)
        return self

    def write(self, batch: Any) -> None:
        """A DataFrame of Spark, pandas or anything with to_arrow() or to_pandas(), or an Arrow table or batch."""
        if isinstance(batch, pa.RecordBatch):
            batch = pa.Table.from_batches([batch])
        elif not isinstance(batch, DataFrame) and hasattr(batch, "to_arrow"):
            batch = batch.to_arrow()
        elif not isinstance(batch, (DataFrame, pa.Table)) and hasattr(batch, "to_pandas"):
            batch = batch.to_pandas()
        df = batch if isinstance(batch, DataFrame) else self.spark.createDataFrame(batch)
        self.rows = df if self.rows is None else self.rows.unionByName(df, allowMissingColumns=True)

    def __exit__(self, kind, *_) -> None:
        if kind is None and self.rows is not None and not self.skip:
            if self.mode == "overwrite":
                self.committed = self.table.overwrite(self.rows, None, self.txn, self.codec, self.chunk_rows)
            else:
                self.committed = self.table.append(self.rows, self.txn, self.codec, self.chunk_rows)


def write_table(df: Any, spark: SparkSession, path: str, **options) -> Table:
    with TableWriter(spark, path, **options) as w:
        w.write(df)
    return w.table
