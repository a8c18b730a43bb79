"""The dtype vocabulary, its Spark carriers, and which widenings are allowed."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from tidemark.errors import SchemaError

#: dtype name to Spark type. Unsigned types use the next wider carrier, so no value is lost. Fixed values.
CARRIERS: dict[str, T.DataType] = {
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(), "float64": T.DoubleType(), "boolean": T.BooleanType(), "date32": T.DateType(), "date64": T.DateType(),
    "timestamp_second": T.TimestampNTZType(), "timestamp_millis": T.TimestampNTZType(), "timestamp_micros": T.TimestampNTZType(), "timestamp_nanos": T.TimestampNTZType(),
    "timestamp_tz": T.TimestampType(), "utf8": T.StringType(), "large_utf8": T.StringType(), "binary": T.BinaryType(), "large_binary": T.BinaryType(),
}
#: Each chain widens from left to right.
CHAINS = (("int8", "int16", "int32", "int64"), ("uint8", "uint16", "uint32", "uint64"), ("float32", "float64"), ("utf8", "large_utf8"), ("binary", "large_binary"))
_BITS = {"int8": 8, "int16": 16, "int32": 32, "int64": 64, "uint8": 8, "uint16": 16, "uint32": 32, "uint64": 64}


_SIMPLE = {kind.simpleString(): kind for kind in CARRIERS.values()}


def _members(text: str) -> list[str]:
    """The parts between commas outside any brackets."""
    parts, depth = [""], 0
    for ch in text:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            parts.append("")
        else:
            parts[-1] += ch
    return [x.strip() for x in parts]


def _plain(text: str) -> T.DataType | None:
    """A decimal, nested or simple type the way Spark writes it, read without a session; None for other spellings."""
    if m := re.fullmatch(r"decimal\((\d+),\s*(\d+)\)", text):
        precision, scale = map(int, m.groups())
        return T.DecimalType(precision, scale) if scale <= precision <= 38 else None
    m = re.fullmatch(r"(array|map|struct)<(.*)>", text)
    if not m:
        return _SIMPLE.get(text)
    parts = _members(m[2])
    names, kinds = ["", ""], parts
    if m[1] == "struct":
        names, kinds = [p.partition(":")[0] for p in parts], [p.partition(":")[2] for p in parts]
        if any(not re.fullmatch(r"\w+", name) for name in names):
            return None
    inner = [_plain(k) for k in kinds]
    if None in inner or len(inner) != {"array": 1, "map": 2}.get(m[1], len(inner)):
        return None
    if m[1] == "struct":
        return T.StructType([T.StructField(n, k) for n, k in zip(names, inner, strict=True)])
    return T.ArrayType(*inner) if m[1] == "array" else T.MapType(*inner)


def carrier(dtype: str) -> T.DataType:
    """The Spark type of a dtype; decimal(p,s) and nested types are written the way Spark writes them."""
    if dtype in CARRIERS:
        return CARRIERS[dtype]
    if (kind := _plain(dtype)) is not None:
        return kind
    try:
        return T.DataType.fromDDL(dtype)
    except Exception as e:
        raise SchemaError(f"unknown dtype {dtype!r}") from e


def dtype_of(kind: T.DataType) -> str:
    """The signed dtype that a Spark type carries."""
    for name in ("int8", "int16", "int32", "int64", "float32", "float64", "boolean", "date32", "timestamp_micros", "timestamp_tz", "utf8", "binary"):
        if CARRIERS[name] == kind:
            return name
    if isinstance(kind, (T.DecimalType, T.StructType, T.ArrayType, T.MapType)):
        return kind.simpleString()
    raise SchemaError(f"no dtype for {kind.simpleString()}")


def can_promote(old: str, new: str) -> bool:
    if old == new:
        return True
    for chain in CHAINS:
        if old in chain and new in chain:
            return chain.index(old) < chain.index(new)
    if old in _BITS and new.startswith("decimal"):
        kind = carrier(new)
        return kind.precision - kind.scale >= len(str(1 << _BITS[old]))
    if old.startswith("decimal") and new.startswith("decimal"):
        a, b = carrier(old), carrier(new)
        return b.scale >= a.scale and b.precision - b.scale >= a.precision - a.scale
    return False
