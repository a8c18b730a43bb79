"""Versioned tables: Parquet files written by Spark, and a log that says which of them count.

Data never passes the driver; it sees manifests, statistics and file names. A write puts files under
names of their own first and commits one entry after, so a failed or lost task leaves nothing that a
reader would see.
"""

from __future__ import annotations

import base64
import datetime
import decimal
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import MergeError, SchemaError, TableExists, TableMissing
from tidemark.functions.partition import Transform, z_order
from tidemark.functions.predicate import ALWAYS, Predicate, Stats
from tidemark.operators.overlap import overlap_groups
from tidemark.sources.log import Log, Snapshot
from tidemark.sources.schema import EvolveOptions, SchemaField, TableSchema
from tidemark.sources.storage import Files, scratch

_ORDERED = (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def _store(v: Any) -> Any:
    """A statistic as JSON that keeps its type."""
    if isinstance(v, decimal.Decimal):
        return {"decimal": str(v)}
    if isinstance(v, datetime.datetime):
        return {"timestamp": v.isoformat()}
    if isinstance(v, datetime.date):
        return {"date": v.isoformat()}
    if isinstance(v, (bytes, bytearray)):
        return {"binary": base64.b64encode(v).decode()}
    if isinstance(v, float) and v != v:
        return None
    return v


def _load(v: Any) -> Any:
    if isinstance(v, dict):
        (kind, x), = v.items()
        return {"decimal": decimal.Decimal, "timestamp": datetime.datetime.fromisoformat, "date": datetime.date.fromisoformat, "binary": base64.b64decode}[kind](x)
    return v


#: How long files that no version names are kept: an append that hasn't committed yet may be about to.
RETENTION_HOURS = 7 * 24


#: How many rows one task of optimize() sorts at most, about: 100 bytes each where they are narrow.
SORT_ROWS = 4_000_000


@dataclass(frozen=True)
class Changed:
    """What a mutation did."""

    rows_matched: int = 0
    rows_inserted: int = 0
    files_untouched: int = 0
    files_rewritten: int = 0
    files_removed: int = 0
    version: int | None = None


class Table:
    def __init__(self, spark: SparkSession, path: str, checkpoint_interval: int = 10, salvage: bool = False):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = Log(Files(spark, self.path), checkpoint_interval, salvage)

    # -- life ------------------------------------------------------------------------------------

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        return bool(Log(Files(spark, path.rstrip("/"))).versions())

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType | TableSchema | None = None, partition_by: tuple[str | Transform, ...] = (), clustering: tuple[str, ...] = (), properties: dict | None = None, **options) -> Table:
        table = cls(spark, path, **options)
        if table.log.versions():
            raise TableExists(path)
        actions: list[dict] = [{"protocol": Snapshot().protocol}, {"metadata": table._metadata(partition_by, clustering, properties)}]
        if schema is not None:
            actions.append({"schema": (schema if isinstance(schema, TableSchema) else TableSchema.of(schema)).to_json()})
        table.log.commit(Snapshot(), "create", actions)
        return table

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> Table:
        table = cls(spark, path, **options)
        if not table.log.versions():
            raise TableMissing(path)
        return table

    @staticmethod
    def _metadata(partition_by: tuple[str | Transform, ...], clustering: tuple[str, ...], properties: dict | None) -> dict:
        spec = [(Transform(p) if isinstance(p, str) else p).to_json() for p in partition_by]
        return {"table_id": uuid.uuid4().hex, "specs": {"0": spec}, "spec_id": 0, "clustering": list(clustering), "properties": properties or {}}

    # -- state -----------------------------------------------------------------------------------

    def snapshot(self, version: int | None = None, timestamp_ms: int | None = None) -> Snapshot:
        return self.log.at(timestamp_ms) if timestamp_ms is not None else self.log.snapshot(version)

    @property
    def version(self) -> int:
        return self.snapshot().version

    def schema(self) -> TableSchema:
        return self.snapshot().chain.current

    def field_ids(self) -> dict[str, int]:
        return {f.name: f.field_id for f in self.schema().fields}

    def live_files(self, version: int | None = None) -> list[str]:
        return sorted(f"{self.path}/{p}" for p in self.snapshot(version).files)

    def history(self) -> DataFrame:
        rows = [(e["version"], e["timestamp_ms"], e["operation"], sum("add" in a for a in e["actions"]), sum("remove" in a for a in e["actions"])) for e in self.log.history()]
        return self.spark.createDataFrame(rows, "version long, timestamp_ms long, operation string, files_added int, files_removed int")

    def inspect(self, version: int | None = None) -> DataFrame:
        """A row for each column of each live file: its statistics and where the file belongs."""
        now = self.snapshot(version)
        rows = []
        for m in now.files.values():
            for f in now.chain.schemas[m["schema_id"]].fields:
                s = m["stats"].get(str(f.field_id), {})
                low, high = (None if (v := _load(s.get(k))) is None else str(v) for k in ("low", "high"))
                rows.append((m["path"], m["schema_id"], m["spec_id"], m["rows"], m["bytes"], str(m["partition"]), f.field_id, f.name, f.dtype, low, high, s.get("nulls")))
        return self.spark.createDataFrame(rows, "path string, schema_id int, spec_id int, rows long, bytes long, partition string, field_id int, name string, dtype string, low string, high string, nulls long")

    # -- reading ---------------------------------------------------------------------------------

    def _plan(self, now: Snapshot, target: TableSchema, schema_id: int) -> list[Column]:
        """Each target column of files of one schema: the file's column by field id, widened, or a fill."""
        there, out = now.chain.schemas[schema_id].by_id(), []
        for f in target.fields:
            kind = f.spark().dataType
            if f.field_id in there:
                c = F.col(f"`{there[f.field_id].name}`")
                c = c if there[f.field_id].spark().dataType == kind else c.cast(kind)
            elif f.default is not None or f.nullable:
                c = F.lit(f.default).cast(kind)
            else:
                raise SchemaError(f"{f.name!r} is required and older files have neither it nor a default")
            out.append(c.alias(f.name))
        return out

    def _manifest_stats(self, now: Snapshot, m: dict, target: TableSchema) -> dict[str, Stats]:
        there, out = now.chain.schemas[m["schema_id"]].by_id(), {}
        for f in target.fields:
            if f.field_id in there:
                s = m["stats"].get(str(f.field_id))
                if s is not None:
                    out[f.name] = Stats(_load(s.get("low")), _load(s.get("high")), s.get("nulls"), m["rows"])
            else:
                out[f.name] = Stats(f.default, f.default, m["rows"] if f.default is None else 0, m["rows"])
        return out

    def _kept_files(self, now: Snapshot, target: TableSchema, predicate: Predicate) -> list[dict]:
        return [m for m in now.files.values() if predicate.may_match(self._manifest_stats(now, m, target))]

    def _read(self, now: Snapshot, files: list[dict], target: TableSchema, with_path: bool = False) -> DataFrame:
        out = None
        for schema_id in sorted({m["schema_id"] for m in files}):
            paths = [f"{self.path}/{m['path']}" for m in files if m["schema_id"] == schema_id]
            own = now.chain.schemas[schema_id].spark()
            df = self.spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in own])).parquet(*paths)
            columns = self._plan(now, target, schema_id)
            if with_path:
                columns.append(F.col("_metadata.file_path").alias("_file"))
            df = df.select(*columns)
            out = df if out is None else out.unionByName(df)
        if out is None:
            fields = [T.StructField(f.name, f.spark().dataType) for f in target.fields] + [T.StructField("_file", T.StringType())] * with_path
            out = self.spark.createDataFrame([], T.StructType(fields))
        return out

    def to_df(self, version: int | None = None, timestamp_ms: int | None = None, columns: list[str] | None = None, predicate: Predicate | None = None, target_schema: TableSchema | None = None) -> DataFrame:
        """The rows as a lazy DataFrame, as of a version or time; files that can't match aren't opened."""
        now = self.snapshot(version, timestamp_ms)
        target = target_schema or now.chain.current
        df = self._read(now, self._kept_files(now, target, predicate or ALWAYS), target)
        if predicate is not None:
            df = df.where(predicate.column())
        return df.select(*columns) if columns else df

    def batches(self, **scan) -> Iterator:
        """The rows, one at a time, partition by partition."""
        return self.to_df(**scan).toLocalIterator()

    def create_view(self, name: str, **scan) -> None:
        self.to_df(**scan).createOrReplaceTempView(name)

    # -- writing files ---------------------------------------------------------------------------

    def _aligned(self, df: DataFrame, schema: TableSchema) -> DataFrame:
        """Columns by name, in the schema's order; missing ones are filled, unknown ones are errors."""
        names = {f.name for f in schema.fields}
        if unknown := [c for c in df.columns if c not in names]:
            raise SchemaError(f"unknown columns: {unknown}")
        out = []
        for f in schema.fields:
            kind = f.spark().dataType
            if f.name in df.columns:
                out.append(F.col(f"`{f.name}`").cast(kind).alias(f.name))
            elif f.nullable or f.default is not None:
                out.append(F.lit(f.default).cast(kind).alias(f.name))
            else:
                raise SchemaError(f"required column {f.name!r} is missing")
        return df.select(*out)

    def _write(self, now: Snapshot, df: DataFrame, schema: TableSchema, codec: str = "zstd", max_rows: int = 0) -> list[dict]:
        """Write rows as new files; their manifests, with typed statistics for each."""
        spec = [Transform(**t) for t in now.metadata["specs"][str(now.metadata["spec_id"])]]
        folder = f"data/{uuid.uuid4().hex}"
        kinds = {f.name: f.spark().dataType for f in schema.fields}
        hidden = [(f"_p{i}", t.column(isinstance(kinds[t.source], T.StringType)).cast("string")) for i, t in enumerate(spec)]
        df = self._aligned(df, schema)
        if clustering := [c for c in now.metadata["clustering"] if c in kinds]:
            df = df.sortWithinPartitions(*clustering)
        writer = df.withColumns(dict(hidden)).write.option("compression", codec)
        if max_rows:
            writer = writer.option("maxRecordsPerFile", max_rows)
        if hidden:
            writer = writer.partitionBy(*(n for n, _ in hidden))
        writer.parquet(f"{self.path}/{folder}")
        return self._manifests(folder, schema, now.metadata["spec_id"], [n for n, _ in hidden])

    def _manifests(self, folder: str, schema: TableSchema, spec_id: int, hidden: list[str]) -> list[dict]:
        kinds = [(f, f.spark().dataType) for f in schema.fields]
        written = self.spark.read.schema(T.StructType([T.StructField(f.name, k) for f, k in kinds] + [T.StructField(h, T.StringType()) for h in hidden])).parquet(f"{self.path}/{folder}")
        aggregates = [F.count("*").alias("rows"), F.first("_metadata.file_size").alias("bytes"), *(F.first(h).alias(h) for h in hidden)]
        for f, kind in kinds:
            c = F.col(f"`{f.name}`")
            aggregates.append(F.count_if(c.isNull()).alias(f"n{f.field_id}"))
            if isinstance(kind, _ORDERED):
                plain = F.when(~F.isnan(c), c) if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else c
                aggregates += [F.min(plain).alias(f"l{f.field_id}"), F.max(c).alias(f"h{f.field_id}")]
        if hidden or any(isinstance(kind, T.StringType) for _, kind in kinds):
            # Spark hashes groups with values of varying length only if an aggregate is an object; else it sorts all rows by their file.
            aggregates.append(F.collect_set(F.lit(0)).alias("_object"))
        out = []
        for r in written.groupBy(F.col("_metadata.file_path").alias("path")).agg(*aggregates).collect():  # a row a file
            stats = {str(f.field_id): {"nulls": r[f"n{f.field_id}"]} | ({"low": _store(r[f"l{f.field_id}"]), "high": _store(r[f"h{f.field_id}"])} if isinstance(kind, _ORDERED) else {}) for f, kind in kinds}
            name = folder + unquote(r.path).split(folder, 1)[1]  # the metadata column holds a URI
            out.append({"path": name, "rows": r.rows, "bytes": r.bytes, "schema_id": schema.schema_id, "spec_id": spec_id, "partition": [r[h] for h in hidden], "stats": stats})
        return sorted(out, key=lambda m: m["path"])

    # -- commits ---------------------------------------------------------------------------------

    def _schema_for(self, now: Snapshot, df: DataFrame) -> tuple[TableSchema, list[dict]]:
        if now.chain.schemas:
            return now.chain.current, []
        schema = TableSchema.of(df.schema)
        return schema, [{"schema": schema.to_json()}]

    @staticmethod
    def _txn(txn: tuple[str, int] | None) -> list[dict]:
        return [{"txn": {"app_id": txn[0], "version": txn[1]}}] if txn else []

    def append(self, df: DataFrame, txn: tuple[str, int] | None = None, codec: str = "zstd", max_rows: int = 0) -> Snapshot:
        """Add rows. txn = (application, number): a number that is committed already adds nothing."""
        now = self.snapshot()
        if txn and now.txns.get(txn[0], -1) >= txn[1]:
            return now
        schema, more = self._schema_for(now, df)
        added = self._write(replace_chain(now, schema), df, schema, codec, max_rows)
        return self.log.commit(now, "append", [*more, *({"add": m} for m in added), *self._txn(txn)])

    def overwrite(self, df: DataFrame, where: Predicate | None = None, txn: tuple[str, int] | None = None, codec: str = "zstd", max_rows: int = 0) -> Snapshot:
        """Replace all rows, or those that a predicate matches, in one commit; history stays readable."""
        now = self.snapshot()
        if txn and now.txns.get(txn[0], -1) >= txn[1]:
            return now
        schema, more = self._schema_for(now, df)
        if where is None:
            actions = [{"remove": {"path": p}} for p in now.files]
        else:
            actions, _ = self._rewrite(now, where, _drop)
        added = self._write(replace_chain(now, schema), df, schema, codec, max_rows)
        return self.log.commit(now, "overwrite", [*more, *actions, *({"add": m} for m in added), *self._txn(txn), {"scan": True}])

    def truncate(self) -> Snapshot:
        now = self.snapshot()
        return self.log.commit(now, "truncate", [{"remove": {"path": p}} for p in now.files])

    def _touched(self, now: Snapshot, where: Predicate) -> tuple[list[dict], dict[str, int]]:
        """Files with matching rows, and how many each has; statistics rule files out before any is read."""
        target = now.chain.current
        if missing := where.columns() - {f.name for f in target.fields}:
            raise SchemaError(f"unknown columns: {sorted(missing)}")
        rows = self._read(now, self._kept_files(now, target, where), target, True).where(where.column())
        counts = self._by_file(rows)
        return [now.files[p] for p in counts], counts

    def _by_file(self, rows: DataFrame) -> dict[str, int]:
        """How many rows there are of each file (_file), by the name that the log has; a row a file reaches the driver."""
        root = self.path.split(":", 1)[-1].rstrip("/") + "/"
        return {unquote(r["_file"]).split(root, 1)[-1]: r["n"] for r in rows.groupBy("_file").agg(F.count("*").alias("n")).collect()}

    def _rewrite(self, now: Snapshot, where: Predicate, change) -> tuple[list[dict], Changed]:
        """Actions that replace the files with matching rows; whole files go without being read again."""
        files, counts = self._touched(now, where)
        partly = [m for m in files if counts[m["path"]] < m["rows"] or change is not _drop]
        gone = [m for m in files if change is _drop and counts[m["path"]] == m["rows"]]
        actions = [{"remove": {"path": m["path"]}} for m in files]
        if partly:
            rows = self._read(now, partly, now.chain.current)
            kept = rows.where(~where.mask()) if change is _drop else change(rows)
            actions += [{"add": m} for m in self._write(now, kept, now.chain.current) if m["rows"]]
        return actions, Changed(sum(counts.values()), 0, len(now.files) - len(files), len(partly), len(gone))

    def delete(self, where: Predicate) -> Changed:
        """Remove the rows that match; rows for which the predicate is NULL stay."""
        now = self.snapshot()
        actions, changed = self._rewrite(now, where, _drop)
        if not changed.rows_matched:
            return changed
        return replace(changed, version=self.log.commit(now, "delete", [*actions, {"scan": True}, {"predicate": str(where)}]).version)

    def update(self, where: Predicate, values: dict[str, Any]) -> Changed:
        """Set columns of the matching rows to literals or Column expressions."""
        now = self.snapshot()
        fields = {f.name: f for f in now.chain.current.fields}
        if unknown := set(values) - set(fields):
            raise SchemaError(f"unknown columns: {sorted(unknown)}")
        for k, v in values.items():
            if v is None and not fields[k].nullable:
                raise SchemaError(f"{k!r} is required")
            _check_literal(fields[k], v)

        def change(rows: DataFrame) -> DataFrame:
            hit = where.mask()
            return rows.withColumns({k: F.when(hit, (v if isinstance(v, Column) else F.lit(v)).cast(fields[k].spark().dataType)).otherwise(F.col(f"`{k}`")) for k, v in values.items()})

        actions, changed = self._rewrite(now, where, change)
        if not changed.rows_matched:
            return changed
        return replace(changed, version=self.log.commit(now, "update", [*actions, {"scan": True}, {"predicate": str(where)}]).version)

    def merge(self, source: DataFrame, on: str, when_matched: str | None = "update", columns: list[str] | None = None, when_not_matched: str | None = "insert", order_by: list[str] | None = None, strict: bool = False, txn: tuple[str, int] | None = None) -> Changed:
        """Join rows of source by a key: matched target rows are updated (all or some columns), deleted or left.

        Of source rows with one key the first (by order_by, else by all columns) updates; the later ones
        count as unmatched if insertion is asked for, as do rows with a NULL key. strict=True refuses
        such repeated keys. One commit; nothing is committed if nothing changes. The source is evaluated once,
        and only files whose statistics allow one of its keys are read. txn as in append().
        """
        now = self.snapshot()
        if txn and now.txns.get(txn[0], -1) >= txn[1]:
            return Changed(files_untouched=len(now.files))
        schema = now.chain.current
        schema.field(on)
        if unknown := set(source.columns) - {f.name for f in schema.fields} - set(order_by or ()):
            raise SchemaError(f"unknown columns: {sorted(unknown)}")
        for n in columns or ():
            schema.field(n)
        at = scratch(self.spark, "merge-source")
        source.write.parquet(at)
        try:
            return self._merge(now, self.spark.read.schema(source.schema).parquet(at), on, when_matched, columns, when_not_matched, order_by, strict, txn)
        finally:
            Files(self.spark, at).delete("")

    def _merge(self, now: Snapshot, source: DataFrame, on: str, when_matched: str | None, columns: list[str] | None, when_not_matched: str | None, order_by: list[str] | None, strict: bool, txn: tuple[str, int] | None) -> Changed:
        schema, key = now.chain.current, F.col(f"`{on}`")
        first = Window.partitionBy(key).orderBy(*(order_by or [f.name for f in source.schema if isinstance(f.dataType, _ORDERED)]))
        ranked = source.withColumn("_rank", F.row_number().over(first))
        if strict and ranked.where(key.isNotNull() & (F.col("_rank") > 1)).take(1):
            raise MergeError(f"the source has a key of {on!r} more than once")
        may = ALWAYS
        if isinstance(source.schema[on].dataType, _ORDERED):
            low, high = source.agg(F.min(key), F.max(key)).first()
            if low is not None and low == low and high == high:
                may = Predicate("between", on, (low, high))
        kept = self._kept_files(now, schema, may)
        target = self._read(now, kept, schema, True)
        keys = source.where(key.isNotNull()).select(key.alias(on)).distinct()
        counts = self._by_file(target.join(keys, on, "left_semi"))
        actions: list[dict] = []
        files = [now.files[p] for p in counts] if when_matched else []
        if files:
            rows = self._read(now, files, schema)
            if when_matched == "delete":
                left = rows.join(keys, on, "left_anti")
            else:
                names = columns or [f.name for f in schema.fields if f.name != on]
                new = ranked.where((F.col("_rank") == 1) & key.isNotNull()).select(key.alias(on), F.lit(True).alias("_hit"), *(F.col(f"`{n}`").alias(f"_new_{n}") for n in names))
                joined = rows.join(new, on, "left")
                left = joined.select(*(F.when(F.col("_hit"), F.col(f"`_new_{f.name}`").cast(f.spark().dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name in names else F.col(f"`{f.name}`") for f in schema.fields))
            actions += [{"remove": {"path": m["path"]}} for m in files]
            actions += [{"add": m} for m in self._write(now, left, schema) if m["rows"]]
        inserted = 0
        if when_not_matched == "insert":
            fresh = ranked
            if counts:  # only those files hold a key of the source
                old = self._read(now, [now.files[p] for p in counts], schema).where(key.isNotNull()).select(key.alias("_old"))
                fresh = ranked.where(F.col("_rank") == 1).join(old, key == F.col("_old"), "left_anti").unionByName(ranked.where(F.col("_rank") > 1))
            added = [m for m in self._write(now, fresh.select(*(F.col(f"`{f.name}`") for f in schema.fields if f.name in source.columns)), schema) if m["rows"]]
            inserted = sum(m["rows"] for m in added)
            actions += [{"add": m} for m in added]
        changed = Changed(sum(counts.values()), inserted, len(now.files) - len(files), len(files), 0)
        if not actions:
            return changed
        return replace(changed, version=self.log.commit(now, "merge", [*actions, *self._txn(txn), {"scan": True}]).version)

    # -- schema and layout -----------------------------------------------------------------------

    def evolve_schema(self, fields: list[SchemaField], options: EvolveOptions = EvolveOptions()) -> TableSchema:
        """Make these the columns; only the log is written."""
        now = self.snapshot()
        new = now.chain.evolved(fields, list(now.files.values()), options)
        self.log.commit(now, "schema_change", [{"schema": new.to_json()}])
        return new

    def _edit(self, edit, options: EvolveOptions = EvolveOptions()) -> TableSchema:
        return self.evolve_schema(edit(list(self.schema().fields)), options)

    def add_column(self, name: str, dtype: str, default: Any = None, nullable: bool = True, doc: str = "") -> TableSchema:
        known = [i for s in self.snapshot().chain.schemas.values() for i in s.by_id()]
        return self._edit(lambda fields: [*fields, SchemaField(max(known, default=0) + 1, name, dtype, nullable, default, doc)])

    def drop_column(self, name: str) -> TableSchema:
        self.schema().field(name)
        return self._edit(lambda fields: [f for f in fields if f.name != name])

    def _change(self, name: str, options: EvolveOptions = EvolveOptions(), **new) -> TableSchema:
        self.schema().field(name)
        return self._edit(lambda fields: [replace(f, **new) if f.name == name else f for f in fields], options)

    def rename_column(self, name: str, to: str) -> TableSchema:
        self.schema().field(name)
        return self._edit(lambda fields: [replace(f, name=to) if f.name == name else f for f in fields])

    def widen_column(self, name: str, dtype: str) -> TableSchema:
        return self._change(name, dtype=dtype)

    def require_column(self, name: str) -> TableSchema:
        return self._change(name, EvolveOptions(allow_null_tightening=True), nullable=False)

    def relax_column(self, name: str) -> TableSchema:
        return self._change(name, nullable=True)

    def set_partitioning(self, partition_by: tuple[str | Transform, ...]) -> int:
        """A new partition spec for later writes, or the number of an equal one that exists."""
        now = self.snapshot()
        spec = [(Transform(p) if isinstance(p, str) else p).to_json() for p in partition_by]
        specs = now.metadata["specs"]
        spec_id = next((int(k) for k, v in specs.items() if v == spec), len(specs))
        if spec_id != now.metadata["spec_id"]:
            self.log.commit(now, "metadata", [{"metadata": now.metadata | {"specs": specs | {str(spec_id): spec}, "spec_id": spec_id}}])
        return spec_id

    def optimize(self, clustering: list[str], files: int | None = None, z: bool = False, target_bytes: int = 128 << 20) -> dict:
        """Merge each group of files whose ranges of all clustering columns overlap, sorted by them.

        z=True orders by interleaved bits of two whole-number columns. Rows don't change. files is how many
        each group becomes at least: a task sorts one file, so none is meant to have more than target_bytes
        or SORT_ROWS rows.
        """
        now = self.snapshot()
        schema = now.chain.current
        ranges = {}
        for p, m in now.files.items():
            s = self._manifest_stats(now, m, schema)
            ranges[p] = [(s[c].low, s[c].high) if c in s and s[c].low is not None else None for c in clustering]
        groups = [g for g in overlap_groups(ranges) if len(g) > 1]
        actions, written = [], 0
        for g in groups:
            rows = self._read(now, [now.files[p] for p in g], schema)
            n = max(files or 1, -(-sum(now.files[p]["bytes"] for p in g) // target_bytes), -(-sum(now.files[p]["rows"] for p in g) // SORT_ROWS))
            key = [z_order(F.col(clustering[0]), F.col(clustering[1]))] if z else [F.col(f"`{c}`") for c in clustering]
            added = self._write(now, rows.repartitionByRange(n, *key).sortWithinPartitions(*key), schema)
            written += len(added)
            actions += [*({"remove": {"path": p}} for p in g), *({"add": m} for m in added)]
        if actions:
            self.log.commit(now, "optimize", actions)
        return {"groups_merged": len(groups), "files_read": sum(map(len, groups)), "files_written": written}

    def compact(self, target_bytes: int = 128 << 20, min_files: int = 2) -> dict:
        """Rewrite files that are smaller than a target into fewer."""
        now = self.snapshot()
        small = [m for m in now.files.values() if m["bytes"] < target_bytes]
        if len(small) < min_files:
            return {"files_read": 0, "files_written": 0}
        n = max(1, -(-sum(m["bytes"] for m in small) // target_bytes))
        added = self._write(now, self._read(now, small, now.chain.current).coalesce(n), now.chain.current)
        self.log.commit(now, "compact", [*({"remove": {"path": m["path"]}} for m in small), *({"add": m} for m in added)])
        return {"files_read": len(small), "files_written": len(added)}

    def vacuum(self, older_than_hours: float = RETENTION_HOURS) -> int:
        """Delete data folders that no version names and that were last written to so long ago.

        Younger ones may belong to writes that have yet to commit; no write may take longer than this.
        """
        before = (time.time() - older_than_hours * 3600) * 1000
        old = [d for d in self.log.files.list("data") if self.log.files.modified_ms(f"data/{d}") < before]
        named = {a["add"]["path"].split("/")[1] for e in self.log.history() for a in e["actions"] if "add" in a}
        stray = [d for d in old if d not in named]
        for d in stray:
            self.log.files.delete(f"data/{d}")
        return len(stray)

    def describe(self) -> dict:
        now = self.snapshot()
        return {"version": now.version, "rows": now.rows, "files": len(now.files), "bytes": sum(m["bytes"] for m in now.files.values()), "schema": [asdict(f) for f in now.chain.current.fields] if now.chain.schemas else [], "metadata": now.metadata}


def _drop(rows: DataFrame) -> DataFrame:
    return rows.limit(0)


def _check_literal(f: SchemaField, v: Any) -> None:
    if v is None or isinstance(v, Column):
        return
    kind = f.spark().dataType
    lawful = {T.BooleanType: bool, T.StringType: str, T.BinaryType: (bytes, bytearray), T.DateType: datetime.date, T.TimestampType: datetime.datetime, T.TimestampNTZType: datetime.datetime, T.DecimalType: (int, decimal.Decimal)}.get(type(kind))
    if isinstance(kind, T.IntegralType):
        bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}[type(kind)]
        if not isinstance(v, int) or isinstance(v, bool) or not -(1 << bits) <= v < 1 << bits:
            raise SchemaError(f"{v!r} is no {f.dtype} for {f.name!r}")
    elif isinstance(kind, T.FractionalType) and lawful is None:
        if not isinstance(v, (int, float)) or isinstance(v, bool):
            raise SchemaError(f"{v!r} is no {f.dtype} for {f.name!r}")
    elif lawful is not None and not isinstance(v, lawful):
        raise SchemaError(f"{v!r} is no {f.dtype} for {f.name!r}")


def replace_chain(now: Snapshot, schema: TableSchema) -> Snapshot:
    """The snapshot as it will be with this schema."""
    if schema.schema_id not in now.chain.schemas:
        now = Snapshot.from_json(now.to_json())
        now.chain.schemas[schema.schema_id] = schema
    return now
