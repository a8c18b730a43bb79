"""Versioned tables: evolution, mutations, time travel, pruning, concurrent commits."""

import json
import multiprocessing
import time

import pytest
from pyspark.sql import functions as F

from tidemark.errors import CommitConflict, LogCorrupt, MergeError, ProtocolError, SchemaError, TableExists, TableMissing, VersionMissing
from tidemark.functions.partition import Transform
from tidemark.functions.predicate import Stats, col
from tidemark.operators.overlap import overlap_groups
from tidemark.sources.log import Log, Snapshot, conflict
from tidemark.sources.reader import read_table, schema_at
from tidemark.sources.schema import EvolveOptions, SchemaField
from tidemark.sources.storage import Files
from tidemark.sources.table import Table
from tidemark.sources.writer import TableWriter


@pytest.fixture
def table(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "t"))
    t.append(spark.createDataFrame([(1, 10, "a"), (2, 20, None), (3, None, "c"), (4, 40, "d")], "id long, x int, s string").coalesce(1))
    return t


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_null_is_two_valued(table):
    table.delete(col("x") > 15)
    assert rows(table.to_df()) == [(1, 10, "a"), (3, None, "c")]
    assert table.delete(col("x") > 1000).version is None and table.version == 2
    assert table.delete(~(col("x") > 15)).rows_matched == 2 and table.to_df().count() == 0
    assert rows(table.to_df(version=1)) == [(1, 10, "a"), (2, 20, None), (3, None, "c"), (4, 40, "d")]


def test_delete_leaves_other_files(spark, table):
    table.append(spark.createDataFrame([(9, 90, "z")], "id long, x int, s string"))
    done = table.delete(col("id") >= 9)
    assert (done.files_untouched, done.files_rewritten, done.files_removed) == (1, 0, 1)


def test_update(table):
    assert table.update(col("s").is_null(), {"x": 7}).rows_matched == 1
    assert rows(table.to_df(columns=["id", "x"])) == [(1, 10), (2, 7), (3, None), (4, 40)]
    for bad in ({"nope": 1}, {"x": "text"}, {"x": 1 << 40}, {"s": 5}):
        with pytest.raises(SchemaError):
            table.update(col("id") == 1, bad)
    table.update(col("id") == 4, {"x": F.col("x") + 1})
    assert table.to_df(predicate=col("x") == 41).count() == 1


def test_merge_rules(spark, table):
    source = spark.createDataFrame([(2, 200, "m"), (2, 201, "n"), (None, 5, "null"), (8, 80, "new")], "id long, x int, s string")
    with pytest.raises(MergeError):
        table.merge(source, "id", strict=True)
    done = table.merge(source, "id", order_by=["x"])
    assert (done.rows_matched, done.rows_inserted) == (1, 3)  # the later row of key 2 and the NULL key are inserted
    assert rows(table.to_df()) == sorted([(1, 10, "a"), (2, 200, "m"), (3, None, "c"), (4, 40, "d"), (2, 201, "n"), (None, 5, "null"), (8, 80, "new")], key=repr)
    table.merge(spark.createDataFrame([(1,)], "id long"), "id", when_matched="delete", when_not_matched=None)
    assert table.to_df(predicate=col("id") == 1).count() == 0


def test_overwrite_where_and_truncate(spark, table):
    table.overwrite(spark.createDataFrame([(50, 1, "o")], "id long, x int, s string"), col("id") <= 2)
    assert [r[0] for r in rows(table.to_df())] == [3, 4, 50]
    table.truncate()
    assert table.to_df().count() == 0 and table.to_df(version=1).count() == 4


def test_evolution(spark, table):
    table.rename_column("s", "label")
    table.widen_column("x", "int64")
    table.add_column("extra", "utf8", default="none", nullable=False)
    table.append(spark.createDataFrame([(5, 1 << 40, "e", "given")], "id long, x long, label string, extra string"))
    assert (5, 1 << 40, "e", "given") in rows(table.to_df()) and (1, 10, "a", "none") in rows(table.to_df())
    assert table.to_df(predicate=col("extra") == "given").count() == 1
    table.update(col("extra") == "none", {"label": "old"})
    assert table.to_df().where("label = 'old'").count() == 4
    table.drop_column("label")
    table.add_column("label", "utf8")
    assert {r[0] for r in table.to_df(columns=["label"]).collect()} == {None}  # another column of the same name
    assert rows(table.to_df(version=1).select("s")) == rows(table.to_df(version=2).select(F.col("label").alias("s")))


def test_evolution_refusals(table):
    for change in (lambda: table.widen_column("x", "utf8"), lambda: table.widen_column("id", "int32"), lambda: table.add_column("n", "int32", nullable=False), lambda: table.add_column("id", "int32"), lambda: table.drop_column("nope"), lambda: table.require_column("x")):
        before = table.version
        with pytest.raises(SchemaError):
            change()
        assert table.version == before
    with pytest.raises(SchemaError):
        table.evolve_schema([SchemaField(1, "a", "int64"), SchemaField(1, "b", "int64")])
    table.require_column("id")  # its statistics prove it
    assert not table.schema().field("id").nullable
    with pytest.raises(SchemaError):
        table.evolve_schema([SchemaField(1, "id", "int64", False), SchemaField(2, "x", "int32", False)], EvolveOptions(True))
    table.relax_column("id")


def test_evolution_is_metadata_only(table):
    files = table.live_files()
    began = time.time()
    table.add_column("more", "float64")
    assert time.time() - began < 2 and table.live_files() == files


def test_time_travel(table):
    table.delete(col("id") == 1)
    t = [e["timestamp_ms"] for e in table.log.history()]
    assert table.to_df(timestamp_ms=t[1]).count() == 4 and table.to_df(timestamp_ms=t[2] + 5).count() == 3
    for bad in ({"version": 9}, {"timestamp_ms": t[0] - 1}):
        with pytest.raises(VersionMissing):
            table.to_df(**bad)


def test_pruning(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "p"))
    for k in range(3):
        t.append(spark.range(k * 100, k * 100 + 100).select("id", (-F.col("id") / 2).alias("neg")).coalesce(1))
    now = t.snapshot()
    kept = lambda p: len(t._kept_files(now, now.chain.current, p))
    assert kept(col("id") > 250) == 1 and kept(col("neg") < -120.0) == 1 and kept(col("id").between(90, 110)) == 2
    assert kept((col("id") < 10) | (col("id") == 299)) == 2 and kept(col("id").is_null()) == 0 and kept(col("id") == "text") == 3
    assert len(t.to_df(predicate=col("id") > 250).inputFiles()) == 1
    plan = t.to_df(predicate=col("id") > 250, columns=["id"])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,250)]" in plan and "ReadSchema: struct<id:bigint>" in plan


def test_optimize_splits_ranges(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "z"))
    for k in range(3):
        t.append(spark.range(0, 300).where(F.col("id") % 3 == k).coalesce(1))
    assert len(t._kept_files(t.snapshot(), t.schema(), col("id") == 150)) == 3
    assert t.optimize(["id"], files=3) == {"groups_merged": 1, "files_read": 3, "files_written": 3}
    assert len(t._kept_files(t.snapshot(), t.schema(), col("id") == 150)) == 1 and t.to_df().count() == 300
    t.compact()
    assert len(t.live_files()) == 1 and t.vacuum() == 0


def test_partition_transforms(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "b"), partition_by=(Transform("id", "bucket", 4), Transform("id", "truncate", 10)))
    t.append(spark.range(40))
    assert t.to_df().columns == ["id"] and {m["partition"][1] for m in t.snapshot().files.values()} == {"0", "10", "20", "30"}
    assert t.set_partitioning(("id",)) == 1 and t.set_partitioning((Transform("id", "bucket", 4), Transform("id", "truncate", 10))) == 0
    with pytest.raises(SchemaError):
        Transform("id", "week").column()


def test_writer_modes(spark, tmp_path):
    path, df = str(tmp_path / "w"), spark.range(5)
    for mode, n in (("error", 5), ("append", 10), ("ignore", 10), ("overwrite", 5)):
        with TableWriter(spark, path, mode=mode) as w:
            w.write(df)
        assert Table.open(spark, path).to_df().count() == n
    with pytest.raises(TableExists), TableWriter(spark, path, mode="errorifexists"):
        pass
    with pytest.raises(RuntimeError), TableWriter(spark, path) as w:
        w.write(df)
        raise RuntimeError
    for _ in range(2):
        with TableWriter(spark, path, txn=("job", 3)) as w:
            w.write(df.toPandas())
    assert Table.open(spark, path).to_df().count() == 10
    with pytest.raises(TableMissing):
        Table.open(spark, str(tmp_path / "nothing"))


def test_log_chain(spark, table):
    first = table.log.files._at(Log.name(1))
    with open(first) as f:
        entry = json.load(f)
    with open(first, "w") as f:
        json.dump(entry | {"operation": "forged"}, f)
    table.log.commit(Snapshot(version=1, timestamp_ms=1, crc=1), "x", [{"unknown": {}}])
    with pytest.raises(LogCorrupt):
        table.snapshot()
    assert Log(table.log.files, salvage=True).snapshot().version == 1


def test_checkpoints_and_protocol(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "c"), checkpoint_interval=3)
    for k in range(5):
        t.append(spark.range(k, k + 1))
    assert [n for n in t.log.files.list("_log") if "checkpoint" in n] == ["00000002.checkpoint.json", "00000005.checkpoint.json"]
    t.log.files.put("_log/00000005.checkpoint.json", b"torn")
    assert t.to_df().count() == 5
    t.log.commit(t.snapshot(), "upgrade", [{"protocol": {"reader": 1, "writer": 9}}])
    with pytest.raises(ProtocolError):
        t.append(spark.range(1))


def test_conflicts(spark, table):
    assert conflict([{"add": {}}], [{"add": {}}]) is None
    base = table.snapshot()
    path = next(iter(base.files))
    table.delete(col("id") == 1)
    with pytest.raises(CommitConflict):
        table.log.commit(base, "delete", [{"remove": {"path": path}}])
    with pytest.raises(CommitConflict):
        stale = table.snapshot()
        table.add_column("a", "int32")
        table.log.commit(stale, "schema_change", [{"schema": stale.chain.current.to_json()}])
    table.log.commit(base, "append", [{"add": next(iter(table.snapshot().files.values())) | {"path": "data/other"}}])  # appends go through


def _race(root, worker):
    log = Log(Files(None, root), 0)
    for k in range(5):
        for _ in range(50):
            try:
                log.commit(log.snapshot(), "append", [{"add": {"path": f"{worker}-{k}", "rows": 1}}])
                break
            except CommitConflict:
                continue


def test_processes_race(tmp_path):
    root = str(tmp_path / "race")
    Log(Files(None, root)).commit(Snapshot(), "create", [])
    workers = [multiprocessing.get_context("spawn").Process(target=_race, args=(root, w)) for w in range(4)]
    for w in workers:
        w.start()
    for w in workers:
        w.join(120)
    now = Log(Files(None, root)).snapshot()
    assert now.version == 20 and len(now.files) == 20


def test_overlap_groups():
    assert overlap_groups({"a": [(0, 5)], "b": [(4, 9)], "c": [(10, 12)]}) == [["a", "b"], ["c"]]
    assert overlap_groups({"a": [(9, 10), (0, 1)], "b": [(10, 11), (2, 3)], "c": [(10, 10), (1, 2)]}) == [["a", "b", "c"]]
    assert overlap_groups({"a": [(0, 1)], "b": [None], "c": [(5, 6)]}) == [["a", "b", "c"]]


def test_predicates(spark):
    df = spark.createDataFrame([(1,), (5,), (10,), (None,), (15,)], "x long")
    got = lambda p: [r.x for r in df.where(p.column()).collect()]
    assert got(col("x") > 5) == [10, 15] and got(~(col("x") > 5)) == [1, 5, None] and got(col("x").isin(1, 15)) == [1, 15]
    assert str((col("x") > 5) & ~col("s").isin("a", "b")) == "(x > 5) AND (NOT (s IN ('a', 'b')))"
    assert not (col("x") > 5).may_match({"x": Stats(None, None, 3, 3)}) and (col("x") >= 5).may_match({"x": Stats(1, 5, 0, 3)})


def test_blanks_slashes_and_colons_in_values_and_paths(spark, tmp_path):
    t = Table.create(spark, f"{tmp_path}/a folder/q 100%25", partition_by=("k",))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(("a b", "x/y", "a:b", "c", "ü%", None, "a b"))], "i int, k string")
    t.append(df)
    assert sorted(r.i for r in t.to_df().collect()) == list(range(7))
    assert t.delete(col("k") == "a b").rows_matched == 2
    assert t.update(col("i") == 1, {"k": "z z"}).rows_matched == 1
    assert t.merge(df.where("i = 2").withColumn("k", F.lit("m/n")), "i").rows_matched == 1
    assert sorted((r.i, r.k) for r in t.to_df().where("k is not null").collect()) == [(1, "z z"), (2, "m/n"), (3, "c"), (4, "ü%")]


def test_vacuum_leaves_what_may_yet_be_committed(spark, tmp_path):
    t = Table.create(spark, f"{tmp_path}/t")
    t.append(spark.range(3))
    now = t.snapshot()
    added = t._write(now, spark.range(3, 5).toDF("id"), now.chain.current)
    assert t.vacuum() == 0
    t.log.commit(now, "append", [{"add": m} for m in added])
    assert t.to_df().count() == 5
    t._write(now, spark.range(9).toDF("id"), now.chain.current)
    assert t.vacuum(older_than_hours=0) == 1 and t.to_df().count() == 5


def test_merge_by_transaction(spark, tmp_path):
    t = Table.create(spark, f"{tmp_path}/t")
    t.append(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (None, "n"), (3, "z")], "k int, v string")
    for _ in range(3):
        t.merge(rows, "k", txn=("app", 7))
    got = sorted(((r.k or 0, r.v) for r in t.to_df().collect()))
    assert got == [(0, "n"), (1, "x"), (1, "y"), (2, "b"), (3, "z")]
    assert t.merge(spark.createDataFrame([(50, "q")], "k int, v string"), "k", when_not_matched=None).files_untouched == len(t.live_files())


def test_claims_through_hadoop(spark, tmp_path):
    files = Files(spark, f"file:{tmp_path}/claims")
    files.local = None
    assert files.put_if_absent("_log/0", b"one") and not files.put_if_absent("_log/0", b"two")
    assert files.read("_log/0") == b"one" and files.list("_log") == ["0"]


def test_read_table(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/f.parquet")
    t = Table.create(spark, f"{tmp_path}/t")
    t.append(spark.range(4))
    t.append(spark.range(4, 6))
    assert read_table(spark, f"{tmp_path}/f.parquet", ["id"], col("id") > 2).count() == 2
    assert read_table(spark, f"{tmp_path}/t", None, col("id") > 2).count() == 3 and read_table(spark, f"{tmp_path}/t", version=1).count() == 4
    assert schema_at(spark, f"{tmp_path}/t").names == schema_at(spark, f"{tmp_path}/f.parquet").names == ["id"]


@pytest.mark.parametrize("layout", [{}, {"partition_by": ("k",)}])
def test_statistics_sort_no_rows(spark, tmp_path, monkeypatch, layout):
    """Statistics of written files keep a row a file in memory, whatever the types of the columns."""
    df = spark.range(50).selectExpr("id", "id % 2 AS k", "if(id % 3 = 0, NULL, concat('n', lpad(id, 2, '0'))) AS s", "CAST(id AS DECIMAL(20,1)) AS d", "id / 2 AS x")
    df = df if layout == {} else df.select("id", "k")
    plans, collect = [], type(df).collect

    def seen(self):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return collect(self)

    monkeypatch.setattr(type(df), "collect", seen)
    t = Table.create(spark, str(tmp_path / "t"), **layout)
    t.append(df.coalesce(1))
    monkeypatch.undo()
    assert plans and not [p for p in plans if "Sort" in p]
    got = {(r.name, r.low, r.high, r.nulls) for r in t.inspect().where("name IN ('s', 'id')").collect()}
    assert got == ({("id", "0", "49", 0), ("s", "n01", "n49", 17)} if layout == {} else {("id", "0", "48", 0), ("id", "1", "49", 0)})


def test_optimize_sorts_bounded_files(spark, tmp_path, monkeypatch):
    """files is the least number: more are written where one task would sort too many rows or bytes."""
    from tidemark.sources import table as module

    monkeypatch.setattr(module, "SORT_ROWS", 1000, raising=False)
    df = spark.range(9000).selectExpr("id AS a", "id * 7919 % 9000 AS b")
    t = Table.create(spark, str(tmp_path / "t"))
    t.append(df.repartition(2))
    assert t.optimize(["a", "b"], files=2, z=True)["files_written"] == 9
    held = [m["rows"] for m in t.snapshot().files.values()]
    assert len(held) == 9 and max(held) < 2000 and rows(t.to_df()) == rows(df)
    monkeypatch.setattr(module, "SORT_ROWS", 1 << 40, raising=False)
    few = Table.create(spark, str(tmp_path / "few"))
    few.append(df.repartition(2))
    assert few.optimize(["a"], files=2)["files_written"] == 2
    assert few.optimize(["a"], files=2)["files_read"] == 0
    wide = Table.create(spark, str(tmp_path / "wide"))
    wide.append(df.repartition(2))
    small = -(-sum(m["bytes"] for m in wide.snapshot().files.values()) // 5)
    assert wide.optimize(["a"], files=2, target_bytes=small)["files_written"] == 5 and rows(wide.to_df()) == rows(df)
