"""Integers and byte strings in binary records, and literals of configuration files, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def big_endian(value: Column, size: int) -> Column:
    """The lowest ``size`` bytes of an integer, the highest first."""
    return F.unhex(F.substring(F.lpad(F.hex(value.cast("long")), 16, "0"), 17 - 2 * size, 2 * size))


def little_endian(value: Column, size: int) -> Column:
    data = big_endian(value, size)
    return F.concat(*(F.substring(data, k, 1) for k in range(size, 0, -1)))


def from_big_endian(data: Column) -> Column:
    """An unsigned integer of at most 7 bytes."""
    return F.conv(F.hex(data), 16, 10).cast("long")


def from_little_endian(data: Column, size: int) -> Column:
    return from_big_endian(F.concat(*(F.substring(data, k, 1) for k in range(size, 0, -1))))


def length_prefixed(data: Column) -> Column:
    """Bytes after their length as a little-endian u32."""
    return F.concat(little_endian(F.octet_length(data), 4), data)


def literal(text: Column, kind: str) -> Column:
    """A configuration literal of kind str, bool, uint, int or float; null if it is none (floats have to be finite)."""
    text = F.trim(text)
    if kind == "str":
        return F.when(text.rlike(r'^".*"$'), F.substr(text, F.lit(2), F.length(text) - 2))
    if kind == "bool":
        return F.when(text == "true", True).when(text == "false", False)
    if kind in ("int", "uint"):
        return F.when(text.rlike(r"^\d+$" if kind == "uint" else r"^-?\d+$"), text.try_cast("long"))
    if kind == "float":
        value = text.try_cast("double")
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    raise ValueError(kind)
