"""Column profiles of a DataFrame, and per-block statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.encoding import route
from tidemark.functions.types import dtype_of


def profile_columns(df: DataFrame) -> DataFrame:
    """column, dtype, route, rows, nulls, distinct, bytes and printed min and max; one pass over the rows.

    distinct is approximate (HyperLogLog++), so a pass holds a few kilobytes a column.
    """
    fields = [f for f in df.schema if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))]
    aggregates = [F.count("*").alias("rows")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        width = F.sum(F.octet_length(c)) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.count(c) * {"byte": 1, "boolean": 1, "short": 2, "integer": 4, "float": 4, "date": 4}.get(f.dataType.typeName(), 8)
        aggregates += [F.count_if(c.isNull()).alias(f"n{i}"), F.approx_count_distinct(c).alias(f"d{i}"), width.alias(f"b{i}"), F.min(c).cast("string").alias(f"l{i}"), F.max(c).cast("string").alias(f"h{i}")]
    one = df.agg(*aggregates)
    rows = [F.struct(F.lit(f.name).alias("column"), F.lit(dtype_of(f.dataType)).alias("dtype"), F.lit(route(dtype_of(f.dataType))).alias("route"), F.col("rows"), F.col(f"n{i}").alias("nulls"), F.col(f"d{i}").alias("distinct"), F.col(f"b{i}").alias("bytes"), F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max")) for i, f in enumerate(fields)]
    return one.select(F.inline(F.array(*rows)))


def block_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, rows, nulls, low, high, crc: what a block's footer would hold; crc is independent of row order."""
    c = F.col(value)
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(c.isNull()).alias("nulls"), F.min(c).alias("low"), F.max(c).alias("high"), F.bit_xor(F.crc32(c.cast("string"))).alias("crc"))


def compression_stats(df: DataFrame, paths: dict[str, str] | None = None, codecs: tuple[str, ...] = ("none", "lz4_raw", "zstd"), folder: str | None = None) -> list[dict]:
    """Bytes of the rows written with each codec, against plain column bytes."""
    from tidemark.sources.storage import Files, scratch

    spark, out = df.sparkSession, []
    plain = profile_columns(df).agg(F.sum("bytes").alias("b"), F.max("rows").alias("n")).first()
    for codec in codecs:
        path = (paths or {}).get(codec) or f"{folder or scratch(spark, 'compression')}/{codec}"
        df.write.mode("overwrite").option("compression", codec).parquet(path)
        files = Files(spark, path)
        size = sum(files.size(f"{path}/{n}") for n in files.list(".") if n.endswith(".parquet"))
        out.append({"codec": codec, "rows": plain.n, "raw_bytes": plain.b, "bytes": size, "ratio": (plain.b or 0) / max(1, size)})
    return out
