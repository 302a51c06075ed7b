"""Building blocks of attribute extraction (E0a-E0d): ordered rules, earliest rules, best evidence, make lookup."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions.expr import let, matched, num_to_text, str_array
from ...masters import KNOWN_MAKES

ATTR_TYPE = "struct<value_text:string,value_num:double,confidence:double,source:string,raw:string>"
MAP_TYPE = f"map<string,{ATTR_TYPE}>"


def _attr(text: Column, num: Column, confidence, source, raw) -> Column:
    confidence = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    source = source if isinstance(source, Column) else F.lit(source)
    raw = raw if isinstance(raw, Column) else F.lit(raw)
    value = F.struct(text.alias("value_text"), num.alias("value_num"), confidence.alias("confidence"),
                     source.alias("source"), raw.cast("string").alias("raw"))
    return F.when(text.isNotNull() & (text != ""), value)


def text_attr(value: Column, confidence, source="regex", raw=None) -> Column:
    return _attr(value, F.lit(None).cast("double"), confidence, source, raw)


def num_attr(value: Column, confidence, source="regex", raw=None) -> Column:
    return let(value.cast("double"), lambda v: _attr(num_to_text(v), v, confidence, source, raw))


def best(first: Column, *others: Column) -> Column:
    """E0c - later evidence replaces earlier only when its confidence is strictly higher."""
    out = first
    for o in others:
        out = let(F.struct(out.alias("p"), o.alias("q")), lambda s: F.when(
            s["p"].isNull() | (s["q"]["confidence"] > s["p"]["confidence"]), s["q"]).otherwise(s["p"]))
    return out


def first_rule(text: Column, rules: list[tuple[str, str]]) -> Column:
    """E0a - struct(value, raw) of the first rule in list order that occurs."""
    return F.coalesce(*[
        let(matched(text, p), lambda m, v=v: F.when(m.isNotNull(), F.struct(F.lit(v).alias("value"), m.alias("raw"))))
        for p, v in rules
    ])


def earliest_rule(text: Column, rules: list[tuple[str, str]]) -> Column:
    """E0b - struct(at, ordinal, value, raw) of the rule that occurs first in the text, ties in list order."""
    return F.array_min(F.array_compact(F.array(*[
        let(F.regexp_instr(text, F.lit(p)), lambda at, i=i, p=p, v=v: F.when(at > 0, F.struct(
            at.alias("at"), F.lit(i).alias("ordinal"), F.lit(v).alias("value"), matched(text, p).alias("raw"))))
        for i, (p, v) in enumerate(rules)
    ])))


def captured(text: Column, *patterns: str) -> Column:
    """struct(raw, g1) of the first pattern that occurs."""
    return F.coalesce(*[
        let(matched(text, p), lambda m, p=p: F.when(
            m.isNotNull(), F.struct(m.alias("raw"), F.regexp_extract(text, p, 1).alias("g1"))))
        for p in patterns
    ])


def prefixed_standard(text: Column, pattern: str, bodies: list[tuple[str, int]], confidence: float) -> Column:
    """'API 600' style value from an alternation with one (body, number) group pair per standard body."""
    value = F.coalesce(*[
        F.concat(F.lit(f"{body} "), F.nullif(F.regexp_extract(text, pattern, g), F.lit(""))) for body, g in bodies])
    return text_attr(value, confidence, "regex", matched(text, pattern))


def make_attr(text: Column, field: Column) -> Column:
    """E0d - the source field if given, otherwise the first known make (in list order) named in the text."""
    pattern = "(?<![A-Z0-9])(" + "|".join(KNOWN_MAKES) + ")(?![A-Z0-9])"
    known = str_array(KNOWN_MAKES)
    given = F.nullif(F.upper(F.trim(field)), F.lit(""))
    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)),
                lambda hits: F.get(F.filter(known, lambda m: F.array_contains(hits, m)), F.lit(0)))
    return F.coalesce(text_attr(given, 1.0, "field"), text_attr(found, 0.85, "dictionary"))


def attribute_map(pairs: list[tuple[str, Column]]) -> Column:
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
