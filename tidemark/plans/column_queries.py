"""Encoding analytics and column profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import blobs, encoding
from tidemark.operators.profile import block_stats, profile_columns
from tidemark.plans.registry import Registry, read

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

#: Rows of events by type, in order of event_id: cents as whole numbers.
_E = "(SELECT event_id, event_type, user_id, CAST(floor(value * 100) AS BIGINT) AS cents, value FROM events) AS e"
_W = "OVER (PARTITION BY event_type ORDER BY event_id)"


def _events(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.floor(F.col("value") * 100).cast("long").alias("cents"), "value")


BY, ORDER = ["event_type"], ["event_id"]


@R.add(f"SELECT event_id, event_type, cents - lag(cents) {_W} AS delta FROM {_E}")
def enc_delta(spark, sf_dir):
    return encoding.deltas(_events(spark, sf_dir), "cents", BY, ORDER).select("event_id", "event_type", "delta")


@R.add(f"SELECT event_id, cents - 2 * lag(cents) {_W} + lag(cents, 2) {_W} AS delta2 FROM {_E}")
def enc_delta2(spark, sf_dir):
    return encoding.deltas(_events(spark, sf_dir), "cents", BY, ORDER).select("event_id", "delta2")


_RUNS = "SELECT r_user, grp, event_type AS value, count(*) AS length FROM (SELECT *, user_id % 7 AS r_user, row_number() OVER (PARTITION BY user_id % 7 ORDER BY event_id) - row_number() OVER (PARTITION BY user_id % 7, event_type ORDER BY event_id) AS grp FROM events) AS t GROUP BY ALL"


@R.add(f"SELECT r_user, value, length, count(*) AS n FROM ({_RUNS}) AS t GROUP BY ALL")
def enc_rle_runs(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("r_user", F.col("user_id") % 7)
    return encoding.runs(e, "event_type", ["r_user"], ORDER).groupBy("r_user", "value", "length").agg(F.count("*").alias("n"))


@R.add("SELECT c_mktsegment, value, row_number() OVER (PARTITION BY c_mktsegment ORDER BY value) - 1 AS code, n FROM (SELECT c_mktsegment, c_nationkey AS value, count(*) AS n FROM customer GROUP BY ALL) AS t")
def enc_dictionary(spark, sf_dir):
    d = encoding.dictionary(read(spark, sf_dir, "customer"), "c_nationkey", ["c_mktsegment"])
    return d.withColumn("code", F.col("code").cast("long"))


@R.add("SELECT l_orderkey, l_linenumber, l_partkey, greatest(1, CAST(length(ltrim(to_binary(l_partkey), '0')) AS INT)) AS bits FROM lineitem")
def enc_bits_needed(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", encoding.bits_needed(F.col("l_partkey")).alias("bits"))


_FOR = """WITH v AS (SELECT event_type, cents - min(cents) OVER (PARTITION BY event_type) AS o, min(cents) OVER (PARTITION BY event_type) AS base FROM {e}),
w AS (SELECT *, CASE WHEN o = 0 THEN 1 ELSE length(ltrim(bin(o), '0')) END AS b FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY b) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM w),
s AS (SELECT event_type, min(base) AS base, CAST(max(b) AS INT) AS max_width, CAST(max(CASE WHEN k = least(CAST(floor(0.99 * n) AS BIGINT), n - 1) THEN b END) AS INT) AS p99_width FROM r GROUP BY event_type),
t AS (SELECT *, max_width > p99_width + 32 AS outlier_mode, CASE WHEN max_width > p99_width + 32 THEN p99_width ELSE max_width END AS width FROM s)
SELECT event_type, t.base, max_width, p99_width, outlier_mode, width, count(*) FILTER (o >= (1::BIGINT << width) - 1) AS outliers FROM t JOIN v USING (event_type) GROUP BY ALL""".format(e=_E)


@R.add(_FOR)
def enc_for_width(spark, sf_dir):
    return encoding.frame_of_reference(_events(spark, sf_dir), "cents", BY)


@R.add(f"WITH f AS ({_FOR}) SELECT event_id, event_type, cents FROM {_E} JOIN f USING (event_type) WHERE cents - base >= (1::BIGINT << width) - 1")
def enc_outliers(spark, sf_dir):
    return encoding.outliers(_events(spark, sf_dir), "cents", BY).select("event_id", "event_type", "cents")


@R.add(f"""WITH m AS (SELECT event_type, cents, greatest(length(ltrim(bin(max(cents) OVER (PARTITION BY event_type)), '0')) - 8, 0) AS s FROM {_E}),
b AS (SELECT event_type, (cents >> CAST(s AS INT)) & 255 AS k, count(*) AS n FROM m GROUP BY ALL),
p AS (SELECT event_type, n / sum(n) OVER (PARTITION BY event_type) AS p FROM b) SELECT event_type, round(sum(-p * log2(p)) / 8, 9) AS entropy FROM p GROUP BY event_type""")
def enc_entropy(spark, sf_dir):
    return encoding.entropy(_events(spark, sf_dir), "cents", BY).select("event_type", F.round("entropy", 9).alias("entropy"))


@R.add("SELECT l_returnflag, count(l_partkey) AS n, count(DISTINCT l_partkey) AS distinct_n, count(DISTINCT l_partkey) / count(l_partkey) AS ratio FROM lineitem GROUP BY l_returnflag")
def enc_cardinality(spark, sf_dir):
    return encoding.cardinality(read(spark, sf_dir, "lineitem"), "l_partkey", ["l_returnflag"]).withColumnRenamed("distinct", "distinct_n")


@R.add("""SELECT * FROM (VALUES ('constant', 'rle'), ('sequential', 'delta'), ('low_card', 'dictionary'), ('random', 'bitslab')) AS t(pattern, strategy)""")
def enc_classify(spark, sf_dir):
    i = F.col("id")
    rows = spark.range(1024).select(i, F.explode(F.create_map(F.lit("constant"), F.lit(42).cast("long"), F.lit("sequential"), i, F.lit("low_card"), F.pmod(i * i * 7 + i * 3, F.lit(8)), F.lit("random"), F.shiftrightunsigned(F.xxhash64(i), 16))).alias("pattern", "value"))
    return encoding.classify(rows, "value", ["pattern"], ["id"])


@R.add(None)
def enc_adaptive_segments(spark, sf_dir):
    return encoding.adaptive_segments(_events(spark, sf_dir), "cents", BY, ORDER)


@R.add(f"SELECT event_type, CAST(min(d) AS BIGINT) AS low, CAST(max(d) AS BIGINT) AS high, count(*) AS rows FROM (SELECT event_type, cents AS d, (row_number() {_W} - 1) // 1024 AS segment FROM {_E}) AS t GROUP BY event_type, segment")
def enc_segment_stats(spark, sf_dir):
    s = encoding.segments(_events(spark, sf_dir), BY, ORDER)
    return s.groupBy("event_type", "segment").agg(F.min("cents").alias("low"), F.max("cents").alias("high"), F.count("*").alias("rows")).drop("segment")


_PREFIX = "len(list_filter(range(1, least(length(v), length(b)) + 1), lambda i: v[:i] = b[:i]))"


@R.add(f"SELECT c_nationkey, count(*) + 1 AS n, round(avg(CASE WHEN v >= b THEN 1.0 ELSE 0.0 END), 9) AS sorted_share, round(avg({_PREFIX}), 9) AS mean_prefix FROM (SELECT c_nationkey, c_name AS v, lag(c_name) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS b FROM customer) AS t WHERE b IS NOT NULL GROUP BY c_nationkey")
def enc_front_prefix(spark, sf_dir):
    f = encoding.front_coding(read(spark, sf_dir, "customer"), "c_name", ["c_nationkey"], ["c_custkey"])
    return f.select("c_nationkey", "n", F.round("sorted_share", 9).alias("sorted_share"), F.round("mean_prefix", 9).alias("mean_prefix"))


_EXACT = " ".join(f"WHEN bool_and(floor(v * {10.0**e:.1f}::DOUBLE + 0.5) / {10.0**e:.1f}::DOUBLE = v) THEN {e}" for e in range(5))


@R.add(f"SELECT k, count(*) AS n, CAST(CASE {_EXACT} END AS INT) AS exponent FROM (SELECT 'price' AS k, l_extendedprice AS v FROM lineitem UNION ALL SELECT 'discount', l_discount FROM lineitem UNION ALL SELECT 'quantity', l_quantity FROM lineitem) AS t GROUP BY k")
def enc_alp_exponent(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    rows = line.select(F.explode(F.create_map(F.lit("price"), "l_extendedprice", F.lit("discount"), "l_discount", F.lit("quantity"), "l_quantity")).alias("k", "v"))
    return encoding.decimal_exponent(rows, "v", ["k"], 4)


@R.add("SELECT vec_id, CAST(len(embedding) AS INT) AS length FROM embeddings")
def nested_lengths(spark, sf_dir):
    return encoding.list_shape(read(spark, sf_dir, "embeddings"), "embedding").select("vec_id", "length")


@R.add("SELECT vec_id, x[1] AS base, list_sum(list_transform(x, lambda e: e - x[1]))::BIGINT AS total FROM (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(e * 1000) AS BIGINT)) AS x FROM embeddings) AS t")
def nested_bases_deltas(spark, sf_dir):
    """Floats are multiplied as floats, as in the SQL; a list without a first element has no base and no total."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x * F.lit(1000).cast("float")).cast("long")).alias("x"))
    first = F.try_element_at("x", F.lit(1))
    total = F.aggregate(F.filter("offsets", lambda x: x.isNotNull()), F.lit(0).cast("long"), lambda a, b: a + b)
    return encoding.list_shape(e, "x").select("vec_id", first.alias("base"), F.when(first.isNotNull(), total).alias("total"))


@R.add("SELECT n_nationkey, 'a,m,z' AS keys FROM nation")
def map_sort_keys(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select("n_nationkey", F.create_map(F.lit("z"), F.lit(1), F.lit("a"), F.lit(2), F.lit("m"), F.lit(3)).alias("m"))
    return n.select("n_nationkey", F.array_join(F.map_keys(encoding.sorted_map(F.col("m"))), ",").alias("keys"))


@R.add("SELECT 's_suppkey' AS \"column\", count(*) AS rows, min(s_suppkey)::VARCHAR AS min, max(s_suppkey)::VARCHAR AS max, 8 * count(*) AS bytes FROM supplier UNION ALL SELECT 's_name', count(*), min(s_name), max(s_name), sum(strlen(s_name))::BIGINT FROM supplier")
def profile_supplier(spark, sf_dir):
    return profile_columns(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")).select("column", "rows", "min", "max", "bytes")


@R.add("SELECT o_orderstatus, count(*) AS rows, CAST(0 AS BIGINT) AS nulls, min(o_custkey) AS low, max(o_custkey) AS high FROM orders GROUP BY o_orderstatus")
def block_statistics(spark, sf_dir):
    return block_stats(read(spark, sf_dir, "orders"), "o_custkey", ["o_orderstatus"]).drop("crc")


@R.add("SELECT c_custkey, c_nationkey::BIGINT AS a FROM customer")
def udf_roundtrip(spark, sf_dir):
    blobs.register(spark)
    c = read(spark, sf_dir, "customer").select("c_custkey", F.array(F.col("c_nationkey").cast("long")).alias("xs"))
    return c.select("c_custkey", F.expr("unpack_longs(pack_longs(xs))[0]").alias("a"))


@R.add("SELECT o_totalprice AS value FROM orders")
def blob_roundtrip(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return blobs.unpack_column(blobs.pack_column(o, "o_totalprice"), o.schema["o_totalprice"].dataType)
