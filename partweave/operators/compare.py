"""Attribute comparison, hard exclusions and substitutions (M2-M5) of a pair of attribute maps."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expr import let, str_map
from ..masters import SCHEMAS, SUBSTITUTION_RULES, VETO_RULES, Field
from .describe import is_generic_of
from .extract import by_family, value_num, value_text

COMPARISON_TYPE = ("array<struct<key:string,label:string,grp:string,a:string,b:string,unit:string,status:string,"
                   "score:double,weight:double,veto:string,is_identity:boolean,is_number:boolean,note:string>>")


def _numeric(f: Field, a: Column, b: Column) -> Column:
    out = lambda s, v, note=None: F.struct(
        F.lit(s).alias("status"), F.lit(v).alias("score"),
        (note if note is not None else F.lit(None).cast("string")).alias("note"))
    rel = F.coalesce(F.try_divide(F.abs(a - b), F.greatest(F.abs(a), F.abs(b))), F.lit(0.0))
    within = F.when(F.lit(f.tolerance > 0), F.lit(f"within ±{int(f.tolerance * 100 + 0.5)}% tolerance"))
    differs = lambda r, fmt: F.concat(F.lit("differs by "), F.format_string(fmt, r * 100), F.lit("%"))
    return let(rel, lambda r: F.when(
        r <= f.tolerance + 1e-9, out("MATCH", 1.0, F.when(r > 0, within)))
        .when(r <= f.tolerance * 3 + 0.02, out("PARTIAL", 0.5, differs(r, "%.1f")))
        .otherwise(out("CONFLICT", 0.0, differs(r, "%.0f"))))


def _textual(a: Column, b: Column) -> Column:
    out = lambda s, v, note=None: F.struct(F.lit(s).alias("status"), F.lit(v).alias("score"),
                                           F.lit(note).cast("string").alias("note"))
    return let(F.struct(F.upper(a).alias("a"), F.upper(b).alias("b")), lambda u: F.when(
        u["a"] == u["b"], out("MATCH", 1.0))
        .when(is_generic_of(u["a"], u["b"]) | is_generic_of(u["b"], u["a"]),
              out("PARTIAL", 0.6, "one record is underspecified"))
        .otherwise(out("CONFLICT", 0.0)))


def compare_field(f: Field, a: Column, b: Column) -> Column:
    """M2 for one schema field; a missing value never conflicts."""
    ta, tb = value_text(a, f.key), value_text(b, f.key)
    out = lambda s, v, note=None: F.struct(F.lit(s).alias("status"), F.lit(v).alias("score"),
                                           F.lit(note).cast("string").alias("note"))
    both = _numeric(f, value_num(a, f.key), value_num(b, f.key)) if f.type == "number" else _textual(ta, tb)
    verdict = (
        F.when(ta.isNull() & tb.isNull(), out("MISSING_BOTH", 0.0))
        .when(ta.isNull(), out("MISSING_A", 0.5, "not stated in record A"))
        .when(tb.isNull(), out("MISSING_B", 0.5, "not stated in record B"))
        .otherwise(both))
    return let(verdict, lambda v: F.struct(
        F.lit(f.key).alias("key"), F.lit(f.label).alias("label"), F.lit(f.group).alias("grp"), ta.alias("a"),
        tb.alias("b"), F.lit(f.unit).cast("string").alias("unit"), v["status"].alias("status"),
        v["score"].alias("score"), F.lit(f.weight).alias("weight"), F.lit(f.veto).cast("string").alias("veto"),
        F.lit(f.identity).alias("is_identity"), F.lit(f.type == "number").alias("is_number"),
        v["note"].alias("note")))


def compare_attributes(category: Column, a: Column, b: Column, schemas=SCHEMAS) -> Column:
    """M2 - array of comparisons in schema order."""
    return by_family(category, lambda s: F.array(*[compare_field(f, a, b) for f in s.fields]), schemas,
                     F.array().cast(COMPARISON_TYPE))


def rule_table(rules=SUBSTITUTION_RULES, directional: bool = False) -> dict[str, str]:
    """(category|key|from|to) -> 'direction<US>rationale'; first rule in list order wins.

    By default a one-way rule lifts the conflict in both orders (only its wording is directional); ``directional``
    accepts it only when record A carries the 'from' value."""
    table: dict[str, str] = {}
    for category, key, source, target, both, why in rules:
        direction = "interchangeable" if both else f"{target} may replace {source} (one-way)"
        ways = [(source, target)] if directional and not both else [(source, target), (target, source)]
        for x, y in ways:
            table.setdefault(f"{category}|{key}|{x.upper()}|{y.upper()}", direction + "\u001f" + why)
    return table


def apply_exclusions(category: Column, comparisons: Column, rules=SUBSTITUTION_RULES,
                     directional: bool = False) -> Column:
    """M4/M5 - struct(comparisons, vetoes, substitutions).  Safety conflicts become vetoes unless a rule covers them."""
    table = rule_table(rules, directional)
    rule_map = str_map(table) if table else F.create_map().cast("map<string,string>")
    ids = str_map({k: v[0] for k, v in VETO_RULES.items()})
    why = str_map({k: v[1] for k, v in VETO_RULES.items()})

    def judged(c: Column) -> Column:
        conflict = c["veto"].isNotNull() & (c["status"] == "CONFLICT")
        rule = F.when(conflict, F.try_element_at(
            rule_map, F.concat_ws("|", category, c["key"], F.upper(c["a"]), F.upper(c["b"]))))
        status = F.when(conflict, F.when(rule.isNotNull(), F.lit("SUBSTITUTABLE")).otherwise(
            F.lit("VETO"))).otherwise(c["status"])
        score = F.when(rule.isNotNull(), F.lit(0.5)).otherwise(c["score"])
        note = F.when(rule.isNotNull(), F.split_part(rule, F.lit("\u001f"), F.lit(1))).otherwise(c["note"])
        return F.struct(*[
            {"status": status, "score": score, "note": note}.get(n, c[n]).alias(n)
            for n in ("key", "label", "grp", "a", "b", "unit", "status", "score", "weight", "veto", "is_identity",
                      "is_number", "note")])

    def veto(c: Column) -> Column:
        unit = F.coalesce(F.concat(F.lit(" "), c["unit"]), F.lit(""))
        return F.struct(
            F.element_at(ids, c["veto"]).alias("rule"), c["veto"].alias("kind"), c["key"].alias("attribute"),
            c["a"].alias("a"), c["b"].alias("b"),
            F.concat(c["label"], F.lit(" differs ("), c["a"], unit, F.lit(" vs "), c["b"], unit, F.lit("): "),
                     F.element_at(why, c["veto"]),
                     F.lit(". Equivalence blocked regardless of similarity score.")).alias("message"))

    def substitution(c: Column) -> Column:
        rule = F.element_at(rule_map, F.concat_ws("|", category, c["key"], F.upper(c["a"]), F.upper(c["b"])))
        return F.concat(c["key"], F.lit(": "), F.split_part(rule, F.lit("\u001f"), F.lit(1)), F.lit(" — "),
                        F.split_part(rule, F.lit("\u001f"), F.lit(2)))

    return let(F.transform(comparisons, judged), lambda cs: F.struct(
        cs.alias("comparisons"),
        F.transform(F.filter(cs, lambda c: c["status"] == "VETO"), veto).alias("vetoes"),
        F.transform(F.filter(cs, lambda c: c["status"] == "SUBSTITUTABLE"), substitution).alias("substitutions")))


def group_score(comparisons: Column, group: str) -> Column:
    """M3 - weighted mean of the comparable scored fields of a group, NULL when there are none."""
    rows = F.filter(comparisons, lambda c: (c["grp"] == group) & (c["weight"] > 0) & (c["status"] != "MISSING_BOTH"))
    return let(rows, lambda r: F.try_divide(
        F.aggregate(r, F.lit(0.0), lambda s, c: s + c["weight"] * c["score"]),
        F.aggregate(r, F.lit(0.0), lambda s, c: s + c["weight"])))


def comparison_summary(comparisons: Column) -> Column:
    """M16 - number of scored fields per comparison status."""
    n = lambda s: F.size(F.filter(comparisons, lambda c: (c["weight"] > 0) & (c["status"] == s)))
    names = ["MATCH", "PARTIAL", "CONFLICT", "VETO", "SUBSTITUTABLE", "MISSING_A", "MISSING_B", "MISSING_BOTH"]
    return F.struct(*[n(s).alias(s.lower()) for s in names])
