"""What the host engine gives every table: joins, grouping sets, windows, set operations, top-k, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.plans.registry import Registry, read

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


def _join(name: str, how: str, sql: str) -> None:
    @R.add(sql, f"join_{name}")
    def query(spark, sf_dir):
        c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
        o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
        return c.join(o, "c_custkey", how)


_O = "(SELECT o_custkey AS c_custkey, o_orderkey FROM orders) AS o"
_join("inner", "inner", f"SELECT c_custkey, c_mktsegment, o_orderkey FROM customer JOIN {_O} USING (c_custkey)")
_join("left", "left", f"SELECT c_custkey, c_mktsegment, o_orderkey FROM customer LEFT JOIN {_O} USING (c_custkey)")
_join("full", "full", f"SELECT c_custkey, c_mktsegment, o_orderkey FROM (SELECT c_custkey, c_mktsegment FROM customer) AS c FULL JOIN {_O} USING (c_custkey)")
_join("semi", "left_semi", f"SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT c_custkey FROM {_O})")
_join("anti", "left_anti", f"SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM {_O})")


@R.add("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("decimal(28,2)").alias("qty"))


@R.add("SELECT o_orderstatus, o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(spark, sf_dir):
    return read(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count_distinct("o_custkey").alias("n"))


@R.add("SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders")
def win_rank(spark, sf_dir):
    w = Window.partitionBy("o_custkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.rank().over(w.orderBy(F.desc("o_totalprice"))).cast("long").alias("r"), F.row_number().over(w.orderBy("o_orderkey")).cast("long").alias("k"))


@R.add("SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier")
def setop_except(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_nationkey").subtract(read(spark, sf_dir, "supplier").select("s_nationkey"))


@R.add("SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def setop_intersect(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_nationkey").intersect(read(spark, sf_dir, "supplier").select("s_nationkey"))


@R.add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@R.add("SELECT n_name, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS revenue, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def example_region_revenue(spark, sf_dir):
    o, c, n = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.groupBy("n_name").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(28,2)").alias("revenue"), F.count("*").alias("orders"))


@R.add("SELECT e.event_id, max(f.event_id) AS before_id FROM events AS e LEFT JOIN events AS f ON f.user_id = e.user_id AND f.event_type = 'purchase' AND (f.ts < e.ts OR f.ts = e.ts AND f.event_id <= e.event_id) AND f.event_id = (SELECT g.event_id FROM events AS g WHERE g.user_id = e.user_id AND g.event_type = 'purchase' AND (g.ts < e.ts OR g.ts = e.ts AND g.event_id <= e.event_id) ORDER BY g.ts DESC, g.event_id DESC LIMIT 1) GROUP BY e.event_id")
def join_as_of(spark, sf_dir):
    """For each event its user's latest purchase so far: one window, no join."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return read(spark, sf_dir, "events").select("event_id", last.alias("before_id"))


@R.add("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL")
def window_hourly(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.groupBy("event_type", F.window("ts", "1 hour").start.cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))
