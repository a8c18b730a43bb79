"""Scans, predicates, time travel, evolution, mutations, layout and formats over versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.partition import Transform, z_decode, z_order
from tidemark.functions.predicate import Predicate, col
from tidemark.operators.overlap import overlap_groups
from tidemark.plans.registry import Registry, read
from tidemark.sources import formats
from tidemark.sources.catalog import Catalog
from tidemark.sources.reader import read_table
from tidemark.sources.storage import scratch
from tidemark.sources.table import Table
from tidemark.sources.writer import TableWriter, write_table
from tidemark.streaming.sink import batch_writer, stream_to

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


def table_of(df: DataFrame, name: str, **layout) -> Table:
    table = Table.create(df.sparkSession, scratch(df.sparkSession, name), **layout)
    table.append(df)
    return table


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem")


LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag"


@R.add("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS sum_qty FROM lineitem WHERE l_quantity BETWEEN 10 AND 30 GROUP BY 1, 2")
def scan_aggregate(spark, sf_dir):
    df = table_of(lines(spark, sf_dir), "scan").to_df(predicate=col("l_quantity").between(10.0, 30.0))
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("decimal(28,2)").alias("sum_qty"))


def _predicate(name: str, p: Predicate, sql: str) -> None:
    @R.add(f"SELECT {LINE} FROM lineitem WHERE {sql}", name)
    def query(spark, sf_dir):
        return lines(spark, sf_dir).where(p.column()).select(*LINE.split(", "))


_predicate("pred_gt", col("l_quantity") > 45.0, "l_quantity > 45")
_predicate("pred_lt", col("l_quantity") < 5.0, "l_quantity < 5")
_predicate("pred_ge", col("l_discount") >= 0.09, "l_discount >= 0.09")
_predicate("pred_le", col("l_discount") <= 0.01, "l_discount <= 0.01")
_predicate("pred_eq", col("l_linenumber") == 3, "l_linenumber = 3")
_predicate("pred_ne", col("l_linenumber") != 3, "l_linenumber <> 3")
_predicate("pred_between", col("l_orderkey").between(100, 900), "l_orderkey BETWEEN 100 AND 900")
_predicate("pred_eq_str", col("l_returnflag") == "R", "l_returnflag = 'R'")
_predicate("pred_in_str", col("l_returnflag").isin("A", "N"), "l_returnflag IN ('A', 'N')")
_predicate("pred_and", (col("l_quantity") > 20.0) & (col("l_returnflag") == "A"), "l_quantity > 20 AND l_returnflag = 'A'")
_predicate("pred_or", (col("l_quantity") > 48.0) | (col("l_linenumber") == 7), "l_quantity > 48 OR l_linenumber = 7")
_predicate("pred_not", ~((col("l_quantity") > 10.0) | (col("l_returnflag") == "N")), "NOT (l_quantity > 10 OR l_returnflag = 'N')")


@R.add("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < -500")
def pred_negative(spark, sf_dir):
    return table_of(read(spark, sf_dir, "customer"), "negative").to_df(predicate=col("c_acctbal") < -500.0, columns=["c_custkey", "c_acctbal"])


@R.add("SELECT event_id, nullif(event_type, 'click') AS kind FROM events WHERE nullif(event_type, 'click') IS NULL")
def pred_is_null(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.nullif("event_type", F.lit("click")).alias("kind"))
    return table_of(e, "nulls").to_df(predicate=col("kind").is_null())


@R.add("SELECT l_orderkey, l_quantity FROM lineitem")
def scan_project(spark, sf_dir):
    return table_of(lines(spark, sf_dir), "project").to_df(columns=["l_orderkey", "l_quantity"])


@R.add("SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders")
def scan_multi_file(spark, sf_dir):
    o, t = read(spark, sf_dir, "orders"), Table.create(spark, scratch(spark, "multi"))
    for k in range(3):
        t.append(o.where(F.col("o_orderkey") % 3 == k))
    return t.to_df().agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def _two_versions(spark, sf_dir) -> Table:
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    t = table_of(o.where("o_orderkey % 2 = 0"), "travel")
    t.append(o.where("o_orderkey % 2 = 1"))
    return t


@R.add("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0")
def tt_version(spark, sf_dir):
    return _two_versions(spark, sf_dir).to_df(version=1)


@R.add("SELECT o_orderkey, o_orderstatus FROM orders")
def tt_latest(spark, sf_dir):
    return _two_versions(spark, sf_dir).to_df()


@R.add("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0")
def tt_timestamp(spark, sf_dir):
    t = _two_versions(spark, sf_dir)
    return t.to_df(timestamp_ms=t.log.history()[-1]["timestamp_ms"] - 1)


@R.add("SELECT * FROM (VALUES (0, 'create', 0, 0), (1, 'append', 1, 0), (2, 'delete', 0, 1)) AS t(version, operation, files_added, files_removed)")
def table_history(spark, sf_dir):
    t = table_of(read(spark, sf_dir, "region").coalesce(1), "history")
    t.delete(col("r_regionkey") >= 0)
    return t.history().drop("timestamp_ms").withColumn("version", F.col("version").cast("int"))


def _customers(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")


def _evolved(spark, sf_dir, change) -> DataFrame:
    c = _customers(spark, sf_dir)
    t = table_of(c.where("c_custkey % 2 = 0"), "evolve")
    change(t)
    names = [f.name for f in t.schema().fields]
    new = c.where("c_custkey % 2 = 1").withColumnsRenamed({"c_name": "c_label"} if "c_label" in names else {}).withColumn("c_extra", F.lit("new"))
    t.append(new.select(*(n for n in new.columns if n in names)))
    return t.to_df()


@R.add("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 2 = 1 THEN 'new' END AS c_extra FROM customer")
def evolve_add_null(spark, sf_dir):
    return _evolved(spark, sf_dir, lambda t: t.add_column("c_extra", "utf8"))


@R.add("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 2 = 1 THEN 'new' ELSE 'none' END AS c_extra FROM customer")
def evolve_add_default(spark, sf_dir):
    return _evolved(spark, sf_dir, lambda t: t.add_column("c_extra", "utf8", default="none", nullable=False))


@R.add("SELECT c_custkey, c_name AS c_label, c_nationkey FROM customer")
def evolve_rename(spark, sf_dir):
    return _evolved(spark, sf_dir, lambda t: t.rename_column("c_name", "c_label"))


@R.add("SELECT c_custkey, c_nationkey FROM customer")
def evolve_drop(spark, sf_dir):
    return _evolved(spark, sf_dir, lambda t: t.drop_column("c_name"))


@R.add("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer")
def evolve_widen_int(spark, sf_dir):
    return _evolved(spark, sf_dir, lambda t: t.widen_column("c_nationkey", "int64"))


@R.add("SELECT c_custkey, c_name, CAST(c_nationkey AS DECIMAL(20,0)) AS c_nationkey FROM customer")
def evolve_widen_decimal(spark, sf_dir):
    return _evolved(spark, sf_dir, lambda t: t.widen_column("c_nationkey", "decimal(20,0)"))


@R.add("SELECT c_custkey, c_name AS c_label, CAST(c_nationkey AS BIGINT) AS c_nationkey, CASE WHEN c_custkey % 2 = 1 THEN 'new' ELSE 'old' END AS c_extra FROM customer WHERE c_nationkey > 10")
def evolve_mixed(spark, sf_dir):
    def change(t):
        t.rename_column("c_name", "c_label")
        t.widen_column("c_nationkey", "int64")
        t.add_column("c_extra", "utf8", default="old")

    return _evolved(spark, sf_dir, change).where("c_nationkey > 10")


def _orders(spark, sf_dir) -> Table:
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("o_priority"))
    return table_of(o.repartitionByRange(4, "o_orderkey"), "orders")


_O = "SELECT o_orderkey, o_custkey, o_orderstatus, nullif(o_orderpriority, '1-URGENT') AS o_priority FROM orders"


@R.add(f"SELECT * FROM ({_O}) AS t WHERE NOT coalesce(o_priority <> '5-LOW', false)")
def delete_where(spark, sf_dir):
    t = _orders(spark, sf_dir)
    t.delete(col("o_priority") != "5-LOW")
    return t.to_df()


@R.add(f"SELECT o_orderkey, o_custkey, CASE WHEN coalesce(o_priority = '2-HIGH', false) THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_priority FROM ({_O}) AS t")
def update_where(spark, sf_dir):
    t = _orders(spark, sf_dir)
    t.update(col("o_priority") == "2-HIGH", {"o_orderstatus": "X"})
    return t.to_df()


def _source(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders").where("o_orderkey % 5 = 0")
    return o.select((F.col("o_orderkey") + F.when(F.col("o_orderkey") % 10 == 0, 1_000_000_000).otherwise(0)).alias("o_orderkey"), F.lit(-1).cast("long").alias("o_custkey"), F.lit("M").alias("o_orderstatus"), F.lit("merged").alias("o_priority"))


_S = "SELECT o_orderkey + CASE WHEN o_orderkey % 10 = 0 THEN 1000000000 ELSE 0 END AS o_orderkey, CAST(-1 AS BIGINT) AS o_custkey, 'M' AS o_orderstatus, 'merged' AS o_priority FROM orders WHERE o_orderkey % 5 = 0"


def _merge(name: str, sql: str, **options) -> None:
    @R.add(sql.format(o=_O, s=_S), name)
    def query(spark, sf_dir):
        t = _orders(spark, sf_dir)
        t.merge(_source(spark, sf_dir), "o_orderkey", **options)
        return t.to_df()


_UPDATED = "SELECT t.o_orderkey, coalesce(s.o_custkey, t.o_custkey) AS o_custkey, coalesce(s.o_orderstatus, t.o_orderstatus) AS o_orderstatus, CASE WHEN s.o_orderkey IS NULL THEN t.o_priority ELSE s.o_priority END AS o_priority FROM ({o}) AS t LEFT JOIN ({s}) AS s USING (o_orderkey)"
_NEW = "SELECT * FROM ({s}) AS s WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)"
_merge("merge_update", _UPDATED, when_not_matched=None)
_merge("merge_delete", "SELECT * FROM ({o}) AS t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({s}) AS s)", when_matched="delete", when_not_matched=None)
_merge("merge_insert", "SELECT * FROM ({o}) AS t UNION ALL " + _NEW, when_matched=None)
_merge("merge_upsert", _UPDATED + " UNION ALL " + _NEW)
_merge("merge_some_columns", "SELECT t.o_orderkey, t.o_custkey, coalesce(s.o_orderstatus, t.o_orderstatus) AS o_orderstatus, t.o_priority FROM ({o}) AS t LEFT JOIN ({s}) AS s USING (o_orderkey)", columns=["o_orderstatus"], when_not_matched=None)


@R.add(f"SELECT * FROM ({_O}) AS t WHERE NOT coalesce(o_orderstatus = 'F', false) UNION ALL SELECT o_orderkey, o_custkey, 'G', o_priority FROM ({_O}) AS t WHERE o_orderstatus = 'F'")
def overwrite_where(spark, sf_dir):
    t = _orders(spark, sf_dir)
    new = t.to_df(predicate=col("o_orderstatus") == "F").withColumn("o_orderstatus", F.lit("G"))
    t.overwrite(new, col("o_orderstatus") == "F")
    return t.to_df()


@R.add("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def overwrite_all(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    t = table_of(n, "overwrite")
    t.overwrite(n.where("n_regionkey = 1"))
    return t.to_df(columns=["n_nationkey", "n_name"])


@R.add("SELECT r_regionkey, r_name FROM region WHERE false")
def truncate_table(spark, sf_dir):
    t = table_of(read(spark, sf_dir, "region"), "truncate")
    t.truncate()
    return t.to_df()


@R.add("SELECT CAST(sum(n) AS BIGINT) AS n, min(low) AS low, max(high) AS high FROM (SELECT count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders GROUP BY o_orderkey % 3) AS t")
def file_stats(spark, sf_dir):
    o, t = read(spark, sf_dir, "orders"), Table.create(spark, scratch(spark, "stats"))
    for k in range(3):
        t.append(o.where(F.col("o_orderkey") % 3 == k))
    i = t.inspect().where("name = 'o_orderkey'")
    return i.agg(F.sum("rows").alias("n"), F.min(F.col("low").cast("long")).alias("low"), F.max(F.col("high").cast("long")).alias("high"))


_RANGES = ((0, 9), (8, 20), (30, 41), (40, 45), (44, 60), (99, 100))


@R.add(f"WITH RECURSIVE r(a, b) AS (VALUES {', '.join(map(str, _RANGES))}), p AS (SELECT x.a AS s, y.a AS t FROM r AS x, r AS y WHERE x.a <= y.b AND y.a <= x.b), c(s, t) AS (SELECT s, t FROM p UNION SELECT c.s, p.t FROM c JOIN p ON c.t = p.s) SELECT s AS low, min(t) AS grp FROM c GROUP BY s")
def overlap(spark, sf_dir):
    groups = overlap_groups({f"{a:03d}": [(a, b)] for a, b in _RANGES})
    return spark.createDataFrame([(int(n), int(g[0])) for g in groups for n in g], "low int, grp int")


@R.add("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def optimize_preserves_rows(spark, sf_dir):
    df = lines(spark, sf_dir).select("l_orderkey", "l_partkey", "l_quantity")
    t = table_of(df.repartition(4), "optimize")
    t.optimize(["l_orderkey", "l_partkey"], files=4, z=True)
    return t.to_df()


@R.add("SELECT s_suppkey, s_name FROM supplier")
def compact_preserves_rows(spark, sf_dir):
    t = table_of(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name").repartition(5), "compact")
    t.compact()
    return t.to_df()


_BITS = " + ".join(f"((l_partkey >> {i}) & 1) * (1::BIGINT << {2 * i + 1}) + ((l_suppkey >> {i}) & 1) * (1::BIGINT << {2 * i})" for i in range(22))


@R.add(f"SELECT DISTINCT l_partkey, l_suppkey, CAST({_BITS} AS BIGINT) AS z, l_partkey AS back_a, l_suppkey AS back_b FROM lineitem")
def zorder_key(spark, sf_dir):
    df = lines(spark, sf_dir).select("l_partkey", "l_suppkey").distinct().withColumn("z", z_order(F.col("l_partkey"), F.col("l_suppkey")))
    a, b = z_decode(F.col("z"))
    return df.withColumn("back_a", a).withColumn("back_b", b)


def _transform(name: str, t: Transform, sql: str | None, string: bool = False) -> None:
    @R.add(f"SELECT p, count(*) AS n FROM (SELECT {sql} AS p FROM orders) AS t GROUP BY p" if sql else None, f"part_{name}")
    def query(spark, sf_dir):
        table = table_of(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate"), "partition", partition_by=(t,))
        rows = [(m["partition"][0], m["rows"]) for m in table.snapshot().files.values()]
        return spark.createDataFrame(rows, "p string, n long").groupBy("p").agg(F.sum("n").alias("n"))


_transform("identity", Transform("o_orderstatus"), "o_orderstatus")
_transform("year", Transform("o_orderdate", "year"), "CAST(year(o_orderdate) AS VARCHAR)")
_transform("month", Transform("o_orderdate", "month"), "strftime(o_orderdate, '%Y-%m')")
_transform("truncate_int", Transform("o_orderkey", "truncate", 500), "CAST(o_orderkey - o_orderkey % 500 AS VARCHAR)")
_transform("truncate_str", Transform("o_orderpriority", "truncate", 3), "substr(o_orderpriority, 1, 3)")
_transform("bucket", Transform("o_orderkey", "bucket", 7), None)


@R.add("SELECT strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%Y-%m-%d-%H') AS h, count(*) AS n FROM orders GROUP BY 1, 2")
def part_day_hour(spark, sf_dir):
    day, hour = (Transform("o_orderdate", k).column() for k in ("day", "hour"))
    return read(spark, sf_dir, "orders").groupBy(day.alias("d"), hour.alias("h")).agg(F.count("*").alias("n"))


@R.add("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O'")
def pruned_partition_scan(spark, sf_dir):
    t = table_of(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "pruned", partition_by=("o_orderstatus",))
    return t.to_df(predicate=col("o_orderstatus") == "O")


@R.add("SELECT event_id, user_id, value FROM events")
def stream_foreach_batch(spark, sf_dir):
    """Runs the stream twice from the start: the second run sends batches that are committed already."""
    e = read(spark, sf_dir, "events")
    t = Table.create(spark, scratch(spark, "stream"))
    for _ in range(2):
        source = spark.readStream.schema(e.schema).parquet(f"{sf_dir}/events.parquet*").select("event_id", "user_id", "value")
        stream_to(source, t, "events", scratch(spark, "stream-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return t.to_df()


@R.add("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def part_identity_text(spark, sf_dir):
    """Partition values with blanks, in a folder with a blank, read back after a delete that hits no row and one that is undone."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    t = Table.create(spark, f"{scratch(spark, 'priorities')}/by priority", partition_by=("o_orderpriority",))
    t.append(o)
    gone = t.delete(col("o_orderpriority") == "4-NOT SPECIFIED")
    t.append(o.where("o_orderpriority = '4-NOT SPECIFIED'") if gone.rows_matched else o.limit(0))
    return read_table(spark, t.path).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@R.add("SELECT * FROM (SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id) AS t UNION ALL SELECT CAST(NULL AS BIGINT), CAST(-1 AS BIGINT)")
def stream_upsert(spark, sf_dir):
    """The last event of each user, by upserts; each batch is sent three times, with a NULL key in one of them."""
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    t = table_of(e.withColumn("event_id", F.lit(0).cast("long")).where("user_id % 2 = 0"), "upserts")
    write = batch_writer(t, "upserts", "user_id")
    null = spark.range(1).select(F.lit(None).cast("long").alias("user_id"), F.lit(-1).cast("long").alias("event_id"))
    for number, batch in enumerate((e.where("user_id % 3 = 0").unionByName(null), e.where("user_id % 3 <> 0"))):
        for _ in range(3):
            write(batch, number)
    return t.to_df()


@R.add("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def catalog_view(spark, sf_dir):
    c = Catalog(spark, scratch(spark, "catalog"))
    c.create_namespace("sales")
    c.create_table("sales.customer_versions").append(read(spark, sf_dir, "customer"))
    c.rename_table("sales.customer_versions", "sales.tm_customers")
    c.register_views("sales")
    return spark.sql("SELECT c_mktsegment, count(*) AS n FROM tm_customers GROUP BY c_mktsegment")


@R.add("SELECT p_partkey, p_brand, p_size FROM part")
def writer_session(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    path = scratch(spark, "session")
    with TableWriter(spark, path, clustering=("p_partkey",), txn=("load", 1)) as w:
        w.write(p.where("p_partkey % 2 = 0"))
        w.write(p.where("p_partkey % 2 = 1").toArrow())
    return write_table(p.limit(0), spark, path, txn=("load", 1)).to_df()


def _format(extension: str) -> None:
    @R.add("SELECT n_nationkey, n_name, n_nationkey * 1.25::DOUBLE AS revenue, n_nationkey % 3 <> 0 AS active FROM nation", f"fmt_{extension}")
    def query(spark, sf_dir):
        df = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", (F.col("n_nationkey") * 1.25).alias("revenue"), (F.col("n_nationkey") % 3 != 0).alias("active"))
        path = f"{scratch(spark, 'format')}.{extension}"
        formats.save(df, path)
        return formats.load(spark, path).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("revenue").cast("double").alias("revenue"), "active")


for _extension in ("csv", "tsv", "jsonl", "json", "parquet", "arrow", "orc", "xlsx"):
    _format(_extension)


@R.add("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation")
def merge_files(spark, sf_dir):
    n, folder = read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), scratch(spark, "merge")
    for k in range(2):
        formats.save(n, f"{folder}/{k}.parquet")
    formats.merge_files(spark, [f"{folder}/0.parquet", f"{folder}/1.parquet"], f"{folder}/all.parquet")
    return formats.load(spark, f"{folder}/all.parquet")


