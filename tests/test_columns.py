"""Types, encoding analytics, formats, catalog, blobs and the command line."""

import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.errors import FormatError, SchemaError, TableExists
from tidemark.functions import blobs, encoding
from tidemark.functions.types import can_promote, carrier, dtype_of
from tidemark.plans import column_queries
from tidemark.sources import formats
from tidemark.sources.catalog import Catalog
from tidemark.sources.table import Table


def test_promotions():
    assert can_promote("int8", "int64") and can_promote("uint16", "uint64") and can_promote("float32", "float64") and can_promote("utf8", "large_utf8")
    assert can_promote("int64", "decimal(20,0)") and can_promote("int32", "decimal(20,2)") and can_promote("decimal(10,2)", "decimal(12,2)")
    for a, b in (("int64", "int32"), ("int32", "uint32"), ("int32", "float64"), ("utf8", "binary"), ("int64", "decimal(10,0)"), ("decimal(10,2)", "decimal(10,4)")):
        assert not can_promote(a, b)
    assert carrier("uint64").simpleString() == "decimal(20,0)" and dtype_of(carrier("array<int>")) == "array<int>"
    with pytest.raises(SchemaError):
        carrier("float128x")


def test_runs_are_capped(spark):
    df = spark.range(10).select(F.lit(1).alias("g"), "id", F.when(F.col("id") < 7, 5).alias("v"))
    got = [(r.run, r.value, r.length) for r in encoding.runs(df, "v", ["g"], ["id"], cap=4).orderBy("run").collect()]
    assert got == [(1, 5, 4), (2, 5, 3), (3, None, 3)]


def test_frame_of_reference_outliers(spark):
    df = spark.range(1000).select(F.lit(1).alias("g"), F.when(F.col("id") == 500, F.lit(1 << 60)).otherwise(F.col("id")).alias("v"))
    r = encoding.frame_of_reference(df, "v", ["g"]).first()
    assert (r.base, r.max_width, r.p99_width, r.outlier_mode, r.width, r.outliers) == (0, 61, 10, True, 10, 1)
    assert encoding.outliers(df, "v", ["g"]).count() == 1


def test_shared_prefix(spark):
    df = spark.createDataFrame([("abcd", "abxy"), ("same", "same"), ("a", "abc"), ("", "x"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(encoding.shared_prefix(F.col("a"), F.col("b"))).collect()] == [2, 4, 1, 0, 0]


def test_decimal_exponent(spark):
    df = spark.createDataFrame([("a", 1.25), ("a", 3.5), ("b", 7.0), ("c", 1 / 3), ("d", float("nan"))], "g string, v double")
    got = {r.g: r.exponent for r in encoding.decimal_exponent(df, "v", ["g"]).collect()}
    assert got["a"] == 2 and got["b"] == 0 and got["d"] is None


def test_adaptive_segments(spark):
    i = F.col("id")
    df = spark.range(3072).select(F.lit(1).alias("g"), "id", F.when(i < 1024, 42).when(i < 2048, i - 1024).otherwise(i + 2952).alias("v"))
    got = [(r.segment, r["first"], r.rows, r.strategy) for r in encoding.adaptive_segments(df, "v", ["g"], ["id"]).orderBy("segment").collect()]
    assert got == [(0, 0, 1024, "rle"), (1, 1024, 2048, "delta")]


def test_nested_bases_of_floats(spark, tmp_path):
    """0.058 * 1000 is 58 as a float and 57.99... as a double; NULLs and empty lists are as in the SQL."""
    rows = [(k, x) for k, x in enumerate([[0.058, 0.5, 0.003], [0.5, 0.058], [], None, [1.0, None, 5.0], [None, 3.0], [-0.058]])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(column_queries.ORACLE_SQL["nested_bases_deltas"]).fetchall()
    got = column_queries.QUERIES["nested_bases_deltas"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and want[0][1] == 58


@pytest.mark.parametrize("extension", ["csv", "tsv", "ndjson", "jsonl", "json", "parquet", "arrow", "feather", "orc", "xlsx"])
def test_formats(spark, tmp_path, extension):
    df = spark.range(6).select("id", (F.col("id") * 1.25 + 0.5).alias("revenue"), F.when(F.col("id") % 2 == 0, "no,rth\t<&\"").otherwise("south").alias("region"), (F.col("id") % 3 != 0).alias("active"))
    path = str(tmp_path / f"x.{extension}")
    formats.save(df, path)
    got = formats.load(spark, path)
    assert sorted(got.select("id", "revenue", "region", "active").collect()) == sorted(df.collect())
    with pytest.raises(Exception):
        formats.save(df, path)


def test_format_refusals(spark):
    assert formats.detect_format("/a/b.PQ") == "parquet" and formats.codec_of("brotli")["compression"] == "zstd"
    for f in (lambda: formats.detect_format("x.doc"), lambda: formats.save(spark.range(1), "/tmp/x.ods"), lambda: formats.codec_of("none"), lambda: formats.load(spark, "/tmp/x.xls")):
        with pytest.raises(FormatError):
            f()


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    c.create_namespace("ns")
    c.create_table("ns.a", spark.range(1).schema).append(spark.range(3))
    assert c.namespaces() == ["ns"] and c.tables("ns") == ["a"] and c.load_table("ns.a").to_df().count() == 3
    c.rename_table("ns.a", "ns.b")
    with pytest.raises(TableExists):
        c.drop_namespace("ns")
    assert c.register_views("ns") == ["b"] and spark.table("b").count() == 3
    assert c.drop_table("ns.b") and not c.drop_table("ns.b") and not c.tables("ns")


def test_blobs(spark):
    assert blobs.unpack(blobs.pack(pa.array([1, None, 3]))).to_pylist() == [1, None, 3]
    frame = pd.DataFrame({"a": [1, 2], "b": ["x", None], "c": [0.5, float("inf")]})
    assert blobs.unpack_frame(blobs.pack_frame(frame)).to_dict() == frame.to_dict()
    packed = blobs.pack_column(spark.range(10).coalesce(1), "id", 4)
    assert sorted(r.n for r in packed.collect()) == [2, 4, 4]


def test_blobs_of_lists(spark):
    """One blob a list, each readable by itself; many short lists take no call of the IPC writer each."""
    lists = [[5], None, [], [1, None, 3], list(range(1000)), [-(1 << 63), (1 << 63) - 1], [7], list(range(64)), list(range(65)), [None]]
    array = pa.array(lists, pa.list_(pa.int64()))
    packed = blobs.pack_lists(array)
    assert [None if b is None else blobs.unpack(b).to_pylist() for b in packed.to_pylist()] == lists
    assert blobs.unpack_lists(packed).to_pylist() == lists and blobs.unpack_lists(blobs.pack_lists(array.slice(3, 4))).to_pylist() == lists[3:7]
    assert blobs.unpack_lists(packed.slice(2, 5)).to_pylist() == lists[2:7] and blobs.unpack_lists(packed.slice(0, 0)).to_pylist() == []
    older = pa.array([None if x is None else blobs.pack(pa.array(x, pa.int64())) for x in lists], pa.binary())
    assert blobs.unpack_lists(older).to_pylist() == lists
    assert blobs.unpack_lists(pa.array([blobs.pack(pa.array([1, 2], pa.int32()))])).to_pylist() == [[1, 2]]
    blobs.register(spark)
    df = spark.createDataFrame(list(enumerate(lists)), "k long, xs array<long>")
    assert [r.ys for r in df.selectExpr("k", "unpack_longs(pack_longs(xs)) AS ys").orderBy("k").collect()] == lists
    assert [r.b is None for r in df.selectExpr("k", "pack_longs(xs) AS b").orderBy("k").collect()] == [x is None for x in lists]


def test_blobs_of_many_lists(monkeypatch):
    calls = []
    monkeypatch.setattr(blobs, "pack", lambda x: calls.append(x))
    monkeypatch.setattr(blobs, "unpack", lambda x: calls.append(x))
    many = pa.array([[k] * (k % 3) for k in range(20_000)], pa.list_(pa.int64()))
    assert blobs.unpack_lists(blobs.pack_lists(many)).equals(many) and not calls


def test_cli(spark, tmp_path, capsys):
    spark.range(4).write.json(str(tmp_path / "in.jsonl"))
    assert cli.main(["convert", str(tmp_path / "in.jsonl"), str(tmp_path / "out.parquet"), "--where", "id > 1"], spark) == 0
    assert spark.read.parquet(str(tmp_path / "out.parquet")).count() == 2
    cli.main(["merge", str(tmp_path / "out.parquet"), str(tmp_path / "out.parquet"), "--to", str(tmp_path / "two.parquet")], spark)
    assert spark.read.parquet(str(tmp_path / "two.parquet")).count() == 4
    t = Table.create(spark, str(tmp_path / "t"))
    t.append(spark.range(4).repartition(2))
    for command in (["inspect"], ["history"], ["optimize", "--by", "id", "--"]):
        assert cli.main([command[0], *command[1:], str(tmp_path / "t")], spark) == 0
    assert '"rows": 4' in capsys.readouterr().out
