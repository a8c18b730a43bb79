"""Namespaces and tables under one root folder."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from tidemark.errors import TableExists, TableMissing
from tidemark.sources.storage import Files
from tidemark.sources.table import Table


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def _path(self, name: str) -> str:
        parts = name.split(".")
        if not all(p and "/" not in p and p not in (".", "..") for p in parts):
            raise TableMissing(f"no lawful name: {name!r}")
        return "/".join(parts)

    def create_namespace(self, name: str) -> None:
        self.files.put(f"{self._path(name)}/_namespace", b"")

    def namespaces(self) -> list[str]:
        return [n for n in self.files.list(".") if self.files.exists(f"{n}/_namespace")]

    def drop_namespace(self, name: str) -> None:
        if self.tables(name):
            raise TableExists(f"{name} has tables")
        self.files.delete(self._path(name))

    def create_table(self, name: str, schema: T.StructType | None = None, **layout) -> Table:
        return Table.create(self.spark, f"{self.root}/{self._path(name)}", schema, **layout)

    def load_table(self, name: str) -> Table:
        return Table.open(self.spark, f"{self.root}/{self._path(name)}")

    def exists(self, name: str) -> bool:
        return Table.exists(self.spark, f"{self.root}/{self._path(name)}")

    def tables(self, namespace: str) -> list[str]:
        return [n for n in self.files.list(self._path(namespace)) if self.exists(f"{namespace}.{n}")]

    def drop_table(self, name: str) -> bool:
        if not self.exists(name):
            return False
        self.files.delete(self._path(name))
        return True

    def rename_table(self, name: str, to: str) -> None:
        if not self.exists(name):
            raise TableMissing(name)
        if self.exists(to):
            raise TableExists(to)
        Files(self.spark, f"{self.root}/{self._path(name)}").rename(f"{self.root}/{self._path(to)}")

    def register_views(self, namespace: str) -> list[str]:
        """Every table of a namespace as a temporary view, so that SQL can read it."""
        out = []
        for n in self.tables(namespace):
            table = self.load_table(f"{namespace}.{n}")
            if table.snapshot().chain.schemas:
                table.create_view(n)
                out.append(n)
        return out
