"""What a column codec would see: deltas, runs, widths, entropy, prefixes, decimal exponents.

All functions work within groups (by) and an order that the caller makes total; nothing needs a global
order. Values are whole numbers of 0 or more unless said otherwise; NULLs are left out of statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 1024
RUN_CAP = 65_535
DICTIONARY_SHARE = 0.05
STRING_DICTIONARY_SHARE = 0.30
STABLE = 0.01
OUTLIER_BITS = 32
ALP_LARGEST, ALP_PROBE, ALP_LEAST_ROWS, ALP_OUTLIERS = 18, 256, 32, 0.02
FRONT_SORTED, FRONT_PREFIX, FRONT_LEAST_ROWS = 0.98, 8, 8


def _window(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def segments(df: DataFrame, by: list[str], order: list[str], size: int = SEGMENT) -> DataFrame:
    """Adds segment: which run of size rows of its group a row is in."""
    return df.withColumn("segment", F.floor((F.row_number().over(_window(by, order)) - 1) / size).cast("long"))


def deltas(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """Adds delta and delta2, the first and second differences; NULL where there is no predecessor."""
    w = _window(by, order)
    one = df.withColumn("delta", F.col(value) - F.lag(value).over(w))
    return one.withColumn("delta2", F.col("delta") - F.lag("delta").over(w))


def runs(df: DataFrame, value: str, by: list[str], order: list[str], cap: int = RUN_CAP) -> DataFrame:
    """Run-length encoding: by, run, value, length; a run longer than cap goes on as the next."""
    w = _window(by, order)
    change = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    island = df.withColumn("_at", F.row_number().over(w)).withColumn("_island", F.sum(change).over(w))
    inside = F.row_number().over(Window.partitionBy(*by, "_island").orderBy("_at")) - 1
    cut = island.withColumn("_cut", F.floor(inside / cap))
    rows = cut.groupBy(*by, "_island", "_cut").agg(F.first(value).alias("value"), F.count("*").alias("length"))
    return rows.withColumn("run", F.row_number().over(Window.partitionBy(*by).orderBy("_island", "_cut"))).select(*by, "run", "value", "length")


def dictionary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, value, code, n: the distinct values of each group in order."""
    rows = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    return rows.withColumn("code", F.row_number().over(Window.partitionBy(*by).orderBy("value")) - 1).select(*by, "value", "code", "n")


def bits_needed(value: Column) -> Column:
    """Bits of a number of 0 or more; 1 for 0."""
    return F.length(F.bin(value.cast("long")))


def frame_of_reference(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, base, max_width, p99_width, outlier_mode, width, outliers: how packed offsets from the minimum are."""
    low = df.where(F.col(value).isNotNull()).withColumn("_base", F.min(value).over(Window.partitionBy(*by)))
    offset = F.col(value) - F.col("_base")
    wide = low.withColumn("_offset", offset).withColumn("_bits", bits_needed(offset))
    by_bits = wide.groupBy(*by, "_base", "_bits").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    ranked = by_bits.withColumn("_upto", F.sum("n").over(w.orderBy("_bits"))).withColumn("_n", F.sum("n").over(w))
    nearest = F.least(F.floor(F.col("_n") * 0.99), F.col("_n") - 1)
    widths = ranked.groupBy(*by, F.col("_base").alias("base")).agg(F.max("_bits").alias("max_width"), F.min(F.when(F.col("_upto") > nearest, F.col("_bits"))).alias("p99_width"))
    mode = F.col("max_width") > F.col("p99_width") + OUTLIER_BITS
    widths = widths.withColumn("outlier_mode", mode).withColumn("width", F.greatest(F.lit(1), F.least(F.lit(64), F.when(mode, F.col("p99_width")).otherwise(F.col("max_width")))))
    sentinel = F.when(F.col("width") >= 63, F.lit((1 << 63) - 1)).otherwise(F.expr("shiftleft(1L, width)") - 1)
    hits = wide.join(widths, by).groupBy(*by).agg(F.count_if(F.col("_offset") >= sentinel).alias("outliers"))
    return widths.join(hits, by)


def entropy(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, entropy: of the eight leading bits below the largest value's, as a share of eight bits."""
    top = df.where(F.col(value).isNotNull()).withColumn("_shift", F.greatest(bits_needed(F.max(value).over(Window.partitionBy(*by))) - 8, F.lit(0)))
    bins = top.groupBy(*by, F.expr(f"shiftright(cast(`{value}` as long), _shift) & 255").alias("_bin")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    return bins.withColumn("_p", share).groupBy(*by).agg((F.sum(-F.col("_p") * F.log2("_p")) / 8).alias("entropy"))


def cardinality(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.count_distinct(value).alias("distinct")).withColumn("ratio", F.when(F.col("n") > 0, F.col("distinct") / F.col("n")).otherwise(0.0))


def stability(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """by, stable: at least four values whose steps are all equal, or spread little for their range."""
    d = deltas(df.where(F.col(value).isNotNull()), value, by, order)
    a = d.groupBy(*by).agg(F.count("*").alias("n"), F.min("delta").alias("lo"), F.max("delta").alias("hi"), F.stddev_pop("delta").alias("sd"))
    return a.select(*by, ((F.col("n") >= 4) & ((F.col("lo") == F.col("hi")) | (F.col("sd") / (F.col("hi") - F.col("lo")) < STABLE))).alias("stable"))


def classify(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """by, strategy: rle, delta, dictionary or bitslab, in that order of preference."""
    w = _window(by, order)
    at = df.where(F.col(value).isNotNull()).withColumn("_at", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    ends = at.groupBy(*by).agg(*(F.max(F.when(F.col("_at") == p, F.col(value))).alias(k) for k, p in (("_first", F.lit(1)), ("_middle", F.floor(F.col("_n") / 2) + 1), ("_last", F.col("_n")))), F.max("_n").alias("_n"))
    all_ = ends.join(entropy(df, value, by), by).join(stability(df, value, by, order), by).join(cardinality(df, value, by).select(*by, "ratio"), by)
    flat = (F.col("_n") >= 3) & (F.col("entropy") < 1e-9) & (F.col("_first") == F.col("_middle")) & (F.col("_middle") == F.col("_last"))
    return all_.select(*by, F.when(flat, "rle").when(F.col("stable"), "delta").when(F.col("ratio") < DICTIONARY_SHARE, "dictionary").otherwise("bitslab").alias("strategy"))


def route(dtype: str) -> str:
    """Where a column goes by its dtype alone."""
    if dtype == "boolean":
        return "rle"
    if dtype in ("int8", "int16", "uint8", "uint16"):
        return "bitslab"
    if dtype.startswith("timestamp"):
        return "delta"
    if dtype in ("utf8", "large_utf8", "binary", "large_binary"):
        return "string"
    if dtype.startswith(("struct", "array", "map")):
        return "nested"
    return "classify"


def outliers(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Rows whose offset does not fit the group's packed width."""
    widths = frame_of_reference(df, value, by).select(*by, "base", "width")
    sentinel = F.when(F.col("width") >= 63, F.lit((1 << 63) - 1)).otherwise(F.expr("shiftleft(1L, width)") - 1)
    return df.join(widths, by).where(F.col(value) - F.col("base") >= sentinel).drop("base", "width")


def shared_prefix(a: Column, b: Column) -> Column:
    """Characters that two strings have in common from the start."""
    differs = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(a.isNull() | b.isNull(), 0).when(differs == 0, F.length(a)).otherwise(differs - 1).cast("int")


def front_coding(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """by, n, sorted_share, mean_prefix, front_coded: whether to store rows as what differs from the row before."""
    w = _window(by, order)
    rows = df.select(*by, F.col(value).alias("_v"), F.lag(value).over(w).alias("_before"))
    prefixes = rows.where(F.col("_before").isNotNull() & F.col("_v").isNotNull()).withColumn("_shared", shared_prefix(F.col("_v"), F.col("_before")))
    a = prefixes.groupBy(*by).agg((F.count("*") + 1).alias("n"), F.avg((F.col("_v") >= F.col("_before")).cast("double")).alias("sorted_share"), F.avg("_shared").alias("mean_prefix"))
    return a.withColumn("front_coded", (F.col("n") >= FRONT_LEAST_ROWS) & (F.col("sorted_share") >= FRONT_SORTED) & (F.col("mean_prefix") >= FRONT_PREFIX))


def exact_at(value: Column, e: int) -> Column:
    """Whether a double is a whole number of 10 ** -e."""
    scale = F.lit(float(10**e))
    return F.coalesce((F.abs(value * scale) < F.lit(9.0e15)) & (F.floor(value * scale + F.lit(0.5)).cast("double") / scale == value), F.lit(False))


def decimal_exponent(df: DataFrame, value: str, by: list[str], largest: int = ALP_LARGEST) -> DataFrame:
    """by, exponent (the least that all values have, else NULL), n."""
    checks = [F.every(exact_at(F.col(value), e)).alias(f"_e{e}") for e in range(largest + 1)]
    a = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), *checks)
    return a.select(*by, "n", F.coalesce(*(F.when(F.col(f"_e{e}"), F.lit(e)) for e in range(largest + 1))).alias("exponent"))


def list_shape(df: DataFrame, value: str) -> DataFrame:
    """Adds length, base (first element, 0 if there is none) and offsets (elements less base) of an array."""
    base = F.coalesce(F.try_element_at(value, F.lit(1)), F.lit(0))
    return df.withColumn("length", F.size(value)).withColumn("base", base).withColumn("offsets", F.transform(value, lambda x: x - base))


def sorted_map(value: Column) -> Column:
    """A map with its entries in order of the keys."""
    return F.map_from_entries(F.array_sort(F.map_entries(value)))


def adaptive_segments(df: DataFrame, value: str, by: list[str], order: list[str], probe: int = SEGMENT, largest: int = 65_536) -> DataFrame:
    """by, segment, first, rows, strategy: neighbouring probes of one strategy joined while they fit.

    Each probe of rows is classified by itself; probes of the same strategy as the one before extend its
    segment up to `largest` rows. Only one row a probe is ordered again.
    """
    cut = segments(df, by, order, probe)
    kinds = classify(cut, value, [*by, "segment"], order).join(cut.groupBy(*by, "segment").agg(F.count("*").alias("rows")), [*by, "segment"])
    w = Window.partitionBy(*by).orderBy("segment")
    change = F.when(F.col("strategy") == F.lag("strategy").over(w), 0).otherwise(1)
    island = kinds.withColumn("_island", F.sum(change).over(w))
    inside = F.row_number().over(Window.partitionBy(*by, "_island").orderBy("segment")) - 1
    merged = island.withColumn("_cut", F.floor(inside / (largest // probe)))
    out = merged.groupBy(*by, "_island", "_cut", "strategy").agg(F.min(F.col("segment") * probe).alias("first"), F.sum("rows").alias("rows"))
    return out.withColumn("segment", F.row_number().over(Window.partitionBy(*by).orderBy("first")) - 1).select(*by, "segment", "first", "rows", "strategy")
