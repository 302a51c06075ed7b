"""Attribute extraction (E1-E9, E11): family dispatch and everything derived from an attribute map."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.expr import half_up
from ...masters import SCHEMAS, CategorySchema
from .bearing import extract_bearing
from .cable import extract_cable
from .fastener import extract_fastener
from .pump import extract_pump
from .rules import MAP_TYPE
from .valve import extract_valve


def extract_attributes(category: Column, text: Column, manufacturer: Column) -> Column:
    """E6 - map<key, struct(value_text, value_num, confidence, source, raw)>.

    One CASE over the family: only the matching family's rules run for a row, and the table is read once."""
    return (
        F.when(category == "BEARING", extract_bearing(text, manufacturer))
        .when(category == "VALVE", extract_valve(text, manufacturer))
        .when(category == "CABLE", extract_cable(text, manufacturer))
        .when(category == "FASTENER", extract_fastener(text))
        .when(category == "PUMP", extract_pump(text, manufacturer))
        .otherwise(F.create_map().cast(MAP_TYPE))
    )


def by_family(category: Column, make, schemas: dict[str, CategorySchema] = SCHEMAS, default: Column | None = None):
    out = None
    for code, schema in schemas.items():
        out = F.when(category == code, make(schema)) if out is None else out.when(category == code, make(schema))
    return out if default is None else out.otherwise(default)


def value_text(attributes: Column, key: str) -> Column:
    return F.try_element_at(attributes, F.lit(key))["value_text"]


def value_num(attributes: Column, key: str) -> Column:
    return F.try_element_at(attributes, F.lit(key))["value_num"]


def missing_required(category: Column, attributes: Column, schemas=SCHEMAS) -> Column:
    """E7"""
    keys = lambda s: F.array(*[F.lit(f.key) for f in s.fields if f.required])
    wanted = by_family(category, keys, schemas, F.array().cast("array<string>"))
    return F.filter(wanted, lambda k: ~F.map_contains_key(attributes, k))


def completeness(category: Column, attributes: Column, schemas=SCHEMAS) -> Column:
    """E8 - weighted share of scored fields that are present."""

    def share(s: CategorySchema) -> Column:
        scored = [f for f in s.fields if f.weight > 0]
        got = sum((F.when(F.map_contains_key(attributes, F.lit(f.key)), f.weight).otherwise(0.0) for f in scored),
                  F.lit(0.0))
        return half_up(got / sum(f.weight for f in scored), 2)

    return by_family(category, share, schemas, F.lit(0.0))


def fingerprint(category: Column, attributes: Column, schemas=SCHEMAS) -> Column:
    """E9 - identity text of a record; NULL when a required identity value is missing."""

    def identity(s: CategorySchema) -> Column:
        parts = []
        for f in s.fields:
            if f.identity:
                v = F.concat(F.lit(f"{f.key}="), value_text(attributes, f.key))
                parts.append(v if f.required else F.coalesce(v, F.lit(f"{f.key}=∅")))
        joined = [F.lit(s.code)]
        for p in parts:
            joined += [F.lit("|"), p]
        return F.concat(*joined)

    return by_family(category, identity, schemas)


def blocking_key(category: Column, attributes: Column, schemas=SCHEMAS) -> Column:
    """Family plus the values of its blocking attributes; NULL when one is missing (concat is NULL-strict)."""

    def block(s: CategorySchema) -> Column:
        joined = [F.lit(s.code)]
        for k in s.blocking_keys:
            joined += [F.lit("|"), value_text(attributes, k)]
        return F.concat(*joined)

    return by_family(category, block, schemas)


def expected_dimension(category: Column, schemas=SCHEMAS) -> Column:
    return by_family(category, lambda s: F.lit(s.uom_dimension), schemas)


def explode_attributes(records: DataFrame, id_col: str = "record_id") -> DataFrame:
    """E11 - one row per (record, attribute)."""
    return records.select(id_col, F.explode("attributes").alias("key", "v")).select(
        id_col, "key", "v.value_text", "v.value_num", "v.confidence", "v.source", "v.raw")
