"""Hash functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offset and prime of the 32-bit FNV-1a checksum.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


def fnv1a32(text: str) -> Column:
    """FNV-1a of a text's UTF-8 bytes."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))  # once, not for each byte
    step = lambda h, two: (h.bitwiseXOR(F.conv(two, 16, 10).cast("long")) * FNV_PRIME).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(pairs, F.lit(FNV_OFFSET).cast("long"), step)
