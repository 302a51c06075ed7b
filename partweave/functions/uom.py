"""Units of measure: alias resolution, context, conversion, compatibility."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..masters import UOM_MASTER
from .expr import compact, let, lookup
from .text import SPACE, trim_text


def _code_table(master) -> dict[str, str]:
    """alias -> code, first unit in master order wins; codes themselves rank before any alias."""
    table: dict[str, str] = {}
    for code, *_, aliases in master:
        for a in aliases:
            table.setdefault(a, code)
    table.update({row[0]: row[0] for row in master})
    return table


def normalize_uom(raw: Column, expected: Column, master=UOM_MASTER) -> Column:
    """U1/U2 - struct(original, code, base_code, dimension, factor, flags).

    ``expected`` is the dimension the record's family is bought in (NULL when unknown); it decides what MT means."""
    codes = _code_table(master)
    dimension = {r[0]: r[2] for r in master}
    base = {r[0]: r[3] for r in master}
    factor = {r[0]: r[4] for r in master}

    def resolve(original: Column) -> Column:
        token = F.regexp_replace(F.upper(original), rf"{SPACE}+", " ")
        is_mt = token.isin("MT", "MT.")
        code = F.when(is_mt, F.when(expected == "LENGTH", F.lit("M")).otherwise(F.lit("TO"))).otherwise(
            lookup(codes, token))

        def describe(c: Column) -> Column:
            dim = F.coalesce(lookup(dimension, c), F.lit("UNKNOWN"))
            flags = compact(
                F.when(original.isNull(), F.lit("UOM_MISSING")),
                F.when(is_mt, F.lit("UOM_AMBIGUOUS_MT")),
                F.when(original.isNotNull() & c.isNull(), F.lit("UOM_UNRECOGNISED")),
                F.when(c != token, F.lit("UOM_NONSTANDARD_ALIAS")),
                F.when(c.isNotNull() & expected.isNotNull() & (expected != "UNKNOWN") & (dim != expected),
                       F.lit("UOM_DIMENSION_MISMATCH")),
            )
            return F.struct(
                original.alias("original"), c.alias("code"), lookup(base, c).alias("base_code"),
                dim.alias("dimension"), F.coalesce(lookup(factor, c), F.lit(1.0)).alias("factor"),
                flags.alias("flags"),
            )

        return let(code, describe)

    return let(F.nullif(trim_text(raw), F.lit("")), resolve)


def to_base_quantity(qty: Column, uom: Column) -> Column:
    """U3 - quantity in the base unit of its dimension."""
    return qty * uom["factor"]


def uom_compatibility(code_a: Column, dim_a: Column, code_b: Column, dim_b: Column) -> Column:
    """U4 - struct(score, reason)."""
    pick = lambda s, r: F.struct(F.lit(s).alias("score"), F.lit(r).alias("reason"))
    return (
        F.when(code_a.isNull() | code_b.isNull(), pick(0.5, "UOM_UNKNOWN"))
        .when(code_a == code_b, pick(1.0, "UOM_SAME"))
        .when((dim_a == dim_b) & (dim_a != "UNKNOWN"), pick(0.9, "UOM_CONVERTIBLE"))
        .otherwise(pick(0.0, "UOM_INCOMPATIBLE"))
    )


def iso_unit(code: Column, master=UOM_MASTER) -> Column:
    """U5 - ISO unit code; unknown codes pass through, missing ones are EA."""
    return F.coalesce(lookup({r[0]: r[5] for r in master}, code), code, F.lit("EA"))


def erp_unit(code: Column) -> Column:
    return F.when(code.isin("M", "KM", "KG", "TO"), code).otherwise(F.lit("EA"))
