"""Partition transforms as Columns, and the Z-order key."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import SchemaError


@dataclass(frozen=True)
class Transform:
    """kind: identity, year, month, day, hour, bucket (n) or truncate (n: width of numbers, length of strings)."""

    source: str
    kind: str = "identity"
    n: int = 0

    @property
    def name(self) -> str:
        return self.source if self.kind == "identity" else f"{self.source}_{self.kind}{self.n or ''}"

    def column(self, string: bool = False) -> Column:
        c = F.col(f"`{self.source}`")
        match self.kind:
            case "identity":
                return c
            case "year":
                return F.year(c)
            case "month":
                return F.date_format(c, "yyyy-MM")
            case "day":
                return F.date_format(c, "yyyy-MM-dd")
            case "hour":
                return F.date_format(c, "yyyy-MM-dd-HH")
            case "bucket" if self.n > 0:
                return F.pmod(F.hash(c), F.lit(self.n))
            case "truncate" if self.n > 0:
                return F.substring(c, 1, self.n) if string else c - F.pmod(c, F.lit(self.n))
        raise SchemaError(f"no such transform: {self}")

    def to_json(self) -> dict:
        return asdict(self)


def _spread(c: Column) -> Column:
    """The 31 low bits of a non-negative number, each in every second place of a long."""
    x = c.bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def z_order(a: Column, b: Column) -> Column:
    """Interleaved bits of two numbers of 0 to 2**31 - 1; bits of a are the higher of each pair."""
    return F.shiftleft(_spread(a.cast("long")), 1).bitwiseOR(_spread(b.cast("long")))


def z_decode(z: Column) -> tuple[Column, Column]:
    def pack(x: Column) -> Column:
        x = x.bitwiseAND(F.lit(0x5555555555555555).cast("long"))
        for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return x

    return pack(F.shiftrightunsigned(z, 1)), pack(z)
