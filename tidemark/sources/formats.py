"""Load and save by file extension: CSV, TSV, NDJSON, JSON, Parquet, Arrow IPC, ORC and spreadsheets."""

from __future__ import annotations

import io
import json
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import FormatError
from tidemark.sources.storage import Files

#: Extensions of each format. Fixed values.
EXTENSIONS = {
    "csv": ("csv",), "tsv": ("tsv",), "ndjson": ("ndjson", "jsonl"), "json": ("json",), "parquet": ("parquet", "pq"),
    "arrow": ("arrow", "ipc", "feather"), "orc": ("orc",), "xlsx": ("xlsx",), "xls": ("xls",), "xlsm": ("xlsm",), "ods": ("ods",),
}
READ_ONLY = ("xls", "xlsm", "ods")
#: Codec names of compression profiles. Fixed values.
PROFILES = {"speed": "none", "balanced": "lz4_raw", "archive": "zstd", "brotli": "zstd"}
STRATEGIES = ("auto", "rle", "delta", "dict", "bitslab", "lz4")


def detect_format(path: str) -> str:
    extension = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
    for name, known in EXTENSIONS.items():
        if extension in known:
            return name
    raise FormatError(f"no known format: {path}")


def supports_write(name: str) -> bool:
    return name not in READ_ONLY


def codec_of(profile: str, strategy: str = "auto") -> dict[str, str]:
    """Parquet writer options of a profile and a strategy."""
    if profile not in PROFILES:
        raise FormatError(f"unknown profile {profile!r}")
    if strategy not in STRATEGIES:
        raise FormatError(f"unknown strategy {strategy!r}")
    return {"compression": PROFILES[profile], "parquet.enable.dictionary": str(strategy in ("auto", "rle", "dict")).lower()}


def load(spark: SparkSession, path: str, sampling: float = 1.0) -> DataFrame:
    """A file or folder of any readable format."""
    match name := detect_format(path):
        case "csv" | "tsv":
            return spark.read.csv(path, header=True, inferSchema=True, sep="\t" if name == "tsv" else ",", samplingRatio=sampling)
        case "ndjson":
            return spark.read.json(path)
        case "json":
            start = Files(spark, os.path.dirname(path) or ".").read(os.path.basename(path)).lstrip()[:1]
            return spark.read.json(path, multiLine=start == b"[")
        case "parquet":
            return spark.read.parquet(path)
        case "orc":
            return spark.read.orc(path)
        case "arrow":
            return _load_arrow(spark, path)
        case "xlsx" | "xlsm":
            return _load_sheet(spark, path)
    raise FormatError(f"{name} can't be read here")


def _load_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Executors read the files; the schema comes from the first one's head."""
    files = spark.read.format("binaryFile").load(path)
    first = files.select("content").head()
    if first is None:
        raise FormatError(f"no file: {path}")
    schema = _arrow_reader(bytes(first.content)).schema
    from pyspark.sql.pandas.types import from_arrow_schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                reader = _arrow_reader(content.as_py())
                if isinstance(reader, pa.ipc.RecordBatchFileReader):
                    yield from (reader.get_batch(i) for i in range(reader.num_record_batches))
                else:
                    yield from reader

    return files.select("content").mapInArrow(read, from_arrow_schema(schema))


def _arrow_reader(data: bytes):
    try:
        return pa.ipc.open_file(pa.BufferReader(data))
    except pa.ArrowInvalid:
        return pa.ipc.open_stream(pa.BufferReader(data))


_CELL = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _load_sheet(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet; the first row names the columns; kinds: boolean < whole < real < text."""
    raw = Files(spark, os.path.dirname(path) or ".").read(os.path.basename(path))
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_CELL}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_CELL}si")]
        sheet = ElementTree.fromstring(z.read(min(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))))
    rows = []
    for row in sheet.iter(f"{_CELL}row"):
        cells = {}
        for k, cell in enumerate(row.iter(f"{_CELL}c")):
            letters = re.match("[A-Z]*", cell.get("r", ""))[0]
            at = sum((ord(ch) - 64) * 26**i for i, ch in enumerate(reversed(letters))) - 1 if letters else k
            kind, v = cell.get("t"), cell.find(f"{_CELL}v")
            if kind == "inlineStr":
                cells[at] = "".join(t.text or "" for t in cell.iter(f"{_CELL}t"))
            elif v is not None and v.text is not None:
                cells[at] = shared[int(v.text)] if kind == "s" else v.text == "1" if kind == "b" else v.text if kind in ("str", "e") else float(v.text)
        rows.append(cells)
    if not rows:
        raise FormatError(f"an empty sheet: {path}")
    names = [str(rows[0].get(i, f"column_{i + 1}")) for i in range(max(rows[0], default=-1) + 1)]
    columns = [[r.get(i) for r in rows[1:]] for i in range(len(names))]
    fields, values = [], []
    for name, column in zip(names, columns, strict=True):
        there = [v for v in column if v is not None]
        if there and all(isinstance(v, bool) for v in there):
            kind, cast = T.BooleanType(), bool
        elif there and all(isinstance(v, (bool, float)) and float(v).is_integer() for v in there):
            kind, cast = T.LongType(), int
        elif there and all(isinstance(v, (bool, float)) for v in there):
            kind, cast = T.DoubleType(), float
        else:
            kind, cast = T.StringType(), lambda v: v if isinstance(v, str) else ("true" if v else "false") if isinstance(v, bool) else f"{v:g}"
        fields.append(T.StructField(name, kind))
        values.append([None if v is None else cast(v) for v in column])
    return spark.createDataFrame(list(zip(*values, strict=True)) if values else [], T.StructType(fields))


def save(df: DataFrame, path: str, mode: str = "errorifexists", profile: str = "archive") -> None:
    """A folder of files in the format of the path's extension; xlsx is one file, for small results."""
    name = detect_format(path)
    if not supports_write(name):
        raise FormatError(f"{name} is read-only")
    writer = df.write.mode(mode)
    match name:
        case "csv" | "tsv":
            writer.csv(path, header=True, sep="\t" if name == "tsv" else ",")
        case "ndjson":
            writer.option("ignoreNullFields", "false").json(path)
        case "json":
            _one_file(df, path, mode, _json_array(df))
        case "parquet":
            writer.options(**codec_of(profile)).parquet(path)
        case "orc":
            writer.orc(path)
        case "arrow":
            _one_file(df, path, mode, _arrow_file(df))
        case "xlsx":
            _one_file(df, path, mode, _sheet_file(df))


def _one_file(df: DataFrame, path: str, mode: str, data: Iterator[bytes]) -> None:
    files, name = Files(df.sparkSession, os.path.dirname(path) or "."), os.path.basename(path)
    if files.exists(name):
        if mode == "ignore":
            return
        if mode != "overwrite":
            raise FormatError(f"it exists: {path}")
    files.put(name, b"".join(data))


def _json_array(df: DataFrame) -> Iterator[bytes]:
    sep = b"["
    for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
        yield sep + r.j.encode()
        sep = b",\n"
    yield b"]" if sep != b"[" else b"[]"


def _arrow_file(df: DataFrame) -> Iterator[bytes]:
    table, sink = df.toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_file(sink, table.schema) as w:
        w.write_table(table)
    yield sink.getvalue().to_pybytes()


def _sheet_file(df: DataFrame) -> Iterator[bytes]:
    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c><v>{json.dumps(v)}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [df.columns, *map(tuple, df.toLocalIterator())])
    space, out = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', io.BytesIO()
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", head + '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", head + f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{relation}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", head + f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{relation}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", head + f'<workbook {space} xmlns:r="{relation}"><sheets><sheet name="rows" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", head + f"<worksheet {space}><sheetData>{body}</sheetData></worksheet>")
    yield out.getvalue()


def merge_files(spark: SparkSession, paths: list[str], to: str, files: int = 1) -> None:
    """One dataset from several, columns by name, in the first one's order."""
    first, *rest = (load(spark, p) for p in paths)
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    save(first.coalesce(files), to)
