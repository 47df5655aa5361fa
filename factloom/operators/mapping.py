"""Raw payloads to typed components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_mapper(schema: str, required: list[str], payload: str = "payload") -> Column:
    """A mapper: the payload as a JSON object of ``schema``; null (declined) if it is none or lacks a required field."""
    parsed = F.from_json(F.col(payload), schema)
    there = F.lit(True)
    for field in required:
        there &= parsed[field].isNotNull()
    return F.when(there, F.to_json(parsed))


def field_or(payload: str, field: str, default) -> Column:
    """A JSON object's field, or ``default`` where it is missing, null or of another type."""
    kind = {bool: "boolean", int: "long", float: "double", str: "string"}[type(default)]
    return F.coalesce(F.get_json_object(payload, f"$.{field}").try_cast(kind), F.lit(default))


def fan_out(payloads: DataFrame, mappers: dict[str, Column]) -> DataFrame:
    """A row (component, value) for each mapper that accepts a payload: the payload is read once, whatever the mappers."""
    offers = F.array(*(F.struct(F.lit(name).alias("component"), value.alias("value")) for name, value in mappers.items()))
    return payloads.withColumn("offer", F.explode(F.filter(offers, lambda o: o["value"].isNotNull()))).select(*payloads.columns, "offer.*")


def declined(payloads: DataFrame, mappers: dict[str, Column]) -> DataFrame:
    """Payloads that no mapper accepts: the dead letters."""
    return payloads.where(F.coalesce(*mappers.values()).isNull())


def tag(text: str) -> Column:
    """What a JSON text is: bool, int, float, bytes (text, object, array, null), or null if it cannot be parsed."""
    kind = F.expr(f"schema_of_variant(try_parse_json({text}))")
    return (
        F.when(kind == "BOOLEAN", "bool").when(kind == "BIGINT", "int")
        .when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), "float").when(kind.isNotNull(), "bytes")
    )


def untagged(text: str, variants: dict[str, str]) -> Column:
    """The first variant (name -> its one field's DDL) whose field parses: struct of name and JSON."""
    out = F.lit(None).cast("struct<variant:string,value:string>")
    for name, ddl in reversed(variants.items()):
        parsed = F.from_json(F.col(text), ddl)
        field = ddl.split()[0]
        out = F.when(parsed[field].isNotNull(), F.struct(F.lit(name).alias("variant"), F.to_json(parsed).alias("value"))).otherwise(out)
    return out


def entities(mapped: DataFrame, source_entity: int, key: Column | None = None) -> DataFrame:
    """Which entity a mapped row is about: the source's own, or, for dynamic sources, one for each key."""
    return mapped.withColumn("entity", F.lit(source_entity).cast("string") if key is None else F.coalesce(key.cast("string"), F.lit(source_entity).cast("string")))
