"""Lists of whole numbers as bytes: each in a fixed number of bits, the lowest first."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a statement's number, entries of a list.
BITS, ENTRIES = 21, 100


def pack(values: list[int], bits: int = BITS, most: int = ENTRIES) -> bytes:
    total = 0
    kept = values[:most]
    for i, value in enumerate(kept):
        if value >> bits or value < 0:
            raise ValueError(f"{value} doesn't fit {bits} bits")
        total |= value << (i * bits)
    return total.to_bytes(len(kept) * bits // 8 + 1, "little")


def unpack(data: bytes, bits: int = BITS) -> list[int]:
    total, mask = int.from_bytes(data, "little"), (1 << bits) - 1
    return [(total >> (i * bits)) & mask for i in range(len(data) * 8 // bits)]


def packed(rows: DataFrame, values: str, bits: int = BITS, most: int = ENTRIES) -> DataFrame:
    """``rows`` with the list column as bytes; a null list stays null, null entries are left out."""

    def run(batches: Iterator) -> Iterator:
        for frame in batches:
            frame[values] = [None if v is None else pack([int(x) for x in v if x is not None], bits, most) for v in frame[values]]
            yield frame

    schema = ", ".join(f"`{f.name}` {'binary' if f.name == values else f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, schema)


def unpacked(rows: DataFrame, values: str, bits: int = BITS) -> DataFrame:
    """The inverse of :func:`packed`."""

    def run(batches: Iterator) -> Iterator:
        for frame in batches:
            frame[values] = [None if v is None else unpack(v, bits) for v in frame[values]]
            yield frame

    schema = ", ".join(f"`{f.name}` {'array<int>' if f.name == values else f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, schema)


def width(size: Column) -> Column:
    """Bits for numbers below ``size``."""
    return (F.floor(F.log2(size)) + 1).cast("int")


def sparse_literal(entries: DataFrame, row: str = "row", col: str = "col", weight: str = "weight") -> DataFrame:
    """``row, literal``: ``{col,weight};...`` of each row, columns in order."""
    pair = F.concat(F.lit("{"), F.col(col).cast("string"), F.lit(","), F.col(weight).cast("string"), F.lit("}"))
    return entries.groupBy(row).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(col), pair.alias("p")))), lambda x: x["p"]), ";").alias("literal"))
