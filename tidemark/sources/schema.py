"""Table schemas with stable field ids, and what may become of them."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from tidemark.errors import SchemaError
from tidemark.functions.types import can_promote, carrier, dtype_of


@dataclass(frozen=True)
class SchemaField:
    field_id: int
    name: str
    dtype: str
    nullable: bool = True
    default: Any = None
    doc: str = ""
    promoted_from: str | None = None

    def spark(self) -> T.StructField:
        return T.StructField(self.name, carrier(self.dtype), True, {"field_id": self.field_id, "logical_dtype": self.dtype})


@dataclass(frozen=True)
class TableSchema:
    schema_id: int
    fields: tuple[SchemaField, ...]
    parent: int | None = None

    def spark(self) -> T.StructType:
        return T.StructType([f.spark() for f in self.fields])

    def by_id(self) -> dict[int, SchemaField]:
        return {f.field_id: f for f in self.fields}

    def field(self, name: str) -> SchemaField:
        for f in self.fields:
            if f.name == name:
                return f
        raise SchemaError(f"no column {name!r}")

    def to_json(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_json(x: dict) -> TableSchema:
        return TableSchema(x["schema_id"], tuple(SchemaField(**f) for f in x["fields"]), x.get("parent"))

    @staticmethod
    def of(schema: T.StructType, schema_id: int = 0) -> TableSchema:
        return TableSchema(schema_id, tuple(SchemaField(i + 1, f.name, (f.metadata or {}).get("logical_dtype") or dtype_of(f.dataType)) for i, f in enumerate(schema)))


@dataclass(frozen=True)
class EvolveOptions:
    #: Allow nullable columns to become required, if the files' statistics prove that they hold no NULL.
    allow_null_tightening: bool = False


@dataclass
class Chain:
    """All schemas of a table, in order."""

    schemas: dict[int, TableSchema] = field(default_factory=dict)

    @property
    def current(self) -> TableSchema:
        if not self.schemas:
            raise SchemaError("the table has no schema yet")
        return self.schemas[max(self.schemas)]

    def evolved(self, fields: list[SchemaField], files: list, options: EvolveOptions = EvolveOptions()) -> TableSchema:
        """The next schema, if it is a lawful one. files: manifests of the live files."""
        ids, names = [f.field_id for f in fields], [f.name for f in fields]
        if len(set(ids)) < len(ids):
            raise SchemaError("a field id occurs twice")
        if len(set(names)) < len(names):
            raise SchemaError("a column name occurs twice")
        if not self.schemas:
            return TableSchema(0, tuple(fields))
        old, known, out = self.current.by_id(), {i for s in self.schemas.values() for i in s.by_id()}, []
        for f in fields:
            carrier(f.dtype)
            before = old.get(f.field_id)
            if before is None:
                if f.field_id in known:
                    raise SchemaError(f"field id {f.field_id} was dropped and can't come back")
                if not f.nullable and f.default is None and files:
                    raise SchemaError(f"required column {f.name!r} needs a default")
            else:
                if not can_promote(before.dtype, f.dtype):
                    raise SchemaError(f"{f.name!r}: {before.dtype} can't become {f.dtype}")
                if before.dtype != f.dtype:
                    f = replace(f, promoted_from=before.dtype)
                if before.nullable and not f.nullable:
                    if not options.allow_null_tightening:
                        raise SchemaError(f"{f.name!r} can't become required without allow_null_tightening")
                    self._prove_no_nulls(f, files)
            out.append(f)
        return TableSchema(max(self.schemas) + 1, tuple(out), max(self.schemas))

    def _prove_no_nulls(self, f: SchemaField, files: list) -> None:
        for m in files:
            had = self.schemas[m["schema_id"]].by_id().get(f.field_id)
            nulls = m["stats"].get(str(f.field_id), {}).get("nulls")
            if nulls == 0 or had is None and f.default is not None:
                continue
            raise SchemaError(f"{f.name!r} can't become required: {m['path']} may hold NULLs")
