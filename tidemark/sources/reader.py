"""One call for whatever lies at a path: a table folder, or files of any readable format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.functions.predicate import Predicate
from tidemark.sources import formats
from tidemark.sources.table import Table


def is_table(spark: SparkSession, path: str) -> bool:
    """Whether a log lies there."""
    return Table.exists(spark, path)


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, predicate: Predicate | None = None, version: int | None = None, timestamp_ms: int | None = None) -> DataFrame:
    """The rows at a path, lazily; the condition and the columns reach the scan. Versions are for tables only."""
    if is_table(spark, path):
        return Table.open(spark, path).to_df(version, timestamp_ms, columns, predicate)
    if version is not None or timestamp_ms is not None:
        raise ValueError(f"no table at {path}: files have no versions")
    df = formats.load(spark, path)
    if predicate is not None:
        df = df.where(predicate.column())
    return df.select(*columns) if columns else df


def schema_at(spark: SparkSession, path: str) -> T.StructType:
    """The columns at a path, without reading rows where the format holds its schema."""
    return Table.open(spark, path).schema().spark() if is_table(spark, path) else formats.load(spark, path).schema
