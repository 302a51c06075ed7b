"""E3 - cable attributes."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions.expr import half_up, let, lookup, matched
from .rules import attribute_map, best, captured, first_rule, make_attr, num_attr, text_attr

# Type code letters and patterns.
TYPE_CODE = r"(?<![A-Z0-9])(A)?(2X|Y)(W|F)?(Y)(?![A-Z0-9])"
INSULATION_CODE = {"2X": "XLPE", "Y": "PVC"}
ARMOUR_CODE = {"W": "WIRE", "F": "STRIP", "": "UNARMOURED"}
GEOMETRY = (r"(?<![0-9.])(\d{1,2}(?:\.5)?)\s*(?:C|CORE|CORES)\s*X\s*(\d{1,3}(?:\.\d{1,2})?)(?:\s*SQMM)?")
CORES = r"(?<![0-9.])(\d{1,2}(?:\.5)?)\s*(?:C|CORE|CORES)(?![A-Z0-9])"
SECTION = r"(?<![0-9.])(\d{1,3}(?:\.\d{1,2})?)\s*SQMM"
KV_PAIR = r"(\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)\s*KV\b"
KV = r"(?<![0-9./])(\d+(?:\.\d+)?)\s*KV\b"
VOLTS = r"(?<![0-9./])(\d{3,5})\s*V\b"
CONDUCTORS = [(r"ALUMINIUM|\bALU?\b", "AL"), (r"COPPER|\bCU\b", "CU")]
INSULATIONS = [(r"CROSS LINKED POLYETHYLENE|\bXLPE\b", "XLPE"), (r"\bEPR\b", "EPR"), (r"\bPVC\b", "PVC")]
ARMOURS = [
    (r"UNARMOURED|UN-ARMOURED", "UNARMOURED"), (r"STRIP ARMOURED|FLAT STRIP|STRIP ARMOUR", "STRIP"),
    (r"WIRE ARMOURED|ROUND WIRE|ARMOURED WIRE|WIRE ARMOUR", "WIRE"), (r"ARMOURED", "ARMOURED"),
]
FIRE = [
    (r"FIRE RETARDANT LOW SMOKE HALOGEN|\bFRLSH\b", "FRLSH"), (r"FIRE RETARDANT LOW SMOKE|\bFRLS\b", "FRLS"),
    (r"LOW SMOKE ZERO HALOGEN|\bLSZH\b", "LSZH"), (r"FIRE SURVIVAL|\bFS\b CABLE", "FIRE_SURVIVAL"),
]
STANDARD = r"\bIS\s*(7098|1554|694)(?:\s*[-(]?\s*(?:PART|PT)?\s*([123I]{1,2}))?"
TYPES = [(r"\bPOWER\b", "POWER"), (r"\bCONTROL\b", "CONTROL"), (r"INSTRUMENTATION|\bSIGNAL\b", "INSTRUMENTATION")]


def extract_cable(text: Column, manufacturer: Column) -> Column:
    code = matched(text, TYPE_CODE)
    letter = lambda g: F.regexp_extract(text, TYPE_CODE, g)
    coded = lambda value: F.when(code.isNotNull(), text_attr(value, 0.9, "lookup", code))
    ruled = lambda rules, conf: let(first_rule(text, rules), lambda r: text_attr(
        r["value"], conf(r) if callable(conf) else conf, "dictionary", r["raw"]))

    joint = matched(text, GEOMETRY)
    cores = F.when(joint.isNotNull(), num_attr(F.regexp_extract(text, GEOMETRY, 1), 0.96, "regex", joint)).otherwise(
        let(captured(text, CORES), lambda m: num_attr(m["g1"], 0.9, "regex", m["raw"])))
    section = F.when(joint.isNotNull(), num_attr(F.regexp_extract(text, GEOMETRY, 2), 0.96, "regex", joint)).otherwise(
        let(captured(text, SECTION), lambda m: num_attr(m["g1"], 0.92, "regex", m["raw"])))
    pair = matched(text, KV_PAIR)
    voltage = F.coalesce(
        F.when(pair.isNotNull(), num_attr(F.regexp_extract(text, KV_PAIR, 2), 0.95, "regex", pair)),
        let(captured(text, KV), lambda m: num_attr(m["g1"], 0.96, "regex", m["raw"])),
        let(captured(text, VOLTS), lambda m: num_attr(
            half_up(m["g1"].cast("double") / 1000, 2), 0.9, "regex", m["raw"])),
        F.when(text.contains("LOW TENSION"), num_attr(F.lit(1.1), 0.6, "derived", "LOW TENSION")))
    conductor = best(coded(F.when(letter(1) == "A", F.lit("AL")).otherwise(F.lit("CU"))), ruled(CONDUCTORS, 0.95))
    insulation = best(coded(lookup(INSULATION_CODE, letter(2))), ruled(INSULATIONS, 0.93))
    armour = best(coded(lookup(ARMOUR_CODE, letter(3))),
                  ruled(ARMOURS, lambda r: F.when(r["value"] == "ARMOURED", 0.65).otherwise(0.92)))
    part = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, STANDARD, 2), "^I$", "1"), "^II$", "2")
    standard = text_attr(
        F.when(matched(text, STANDARD).isNotNull(), F.concat(
            F.lit("IS "), F.regexp_extract(text, STANDARD, 1),
            F.when(F.length(part) > 0, F.concat(F.lit("-"), part)).otherwise(F.lit("")))),
        0.93, "regex", matched(text, STANDARD))

    def finish(x: Column) -> Column:
        number = lambda name: F.coalesce(x[name]["value_num"], F.lit(0.0))
        insul = x["insulation"]["value_text"]
        derived = (
            F.when((number("section") >= 4) | (number("voltage") >= 3.3) | F.coalesce(insul == "XLPE", F.lit(False)),
                   text_attr(F.lit("POWER"), 0.75, "derived"))
            .when((number("section") > 0) & (number("section") <= 2.5)
                  & (F.coalesce(insul == "PVC", F.lit(False)) | (number("cores") >= 5)),
                  text_attr(F.lit("CONTROL"), 0.72, "derived")))
        cable_type = F.coalesce(ruled(TYPES, 0.95), derived)
        return let(cable_type, lambda t: attribute_map([
            ("conductor", x["conductor"]), ("insulation", x["insulation"]), ("armour", x["armour"]),
            ("cores", x["cores"]), ("cross_section_sqmm", x["section"]),
            ("voltage_grade_kv", F.coalesce(x["voltage"], F.when(
                t["value_text"] == "CONTROL",
                num_attr(F.lit(1.1), 0.6, "derived", "IS 1554-1 control cable default")))),
            ("fire_performance", ruled(FIRE, 0.94)), ("standard", standard), ("cable_type", t),
            ("manufacturer", make_attr(text, manufacturer)),
        ]))

    return let(F.struct(cores.alias("cores"), section.alias("section"), voltage.alias("voltage"),
                        conductor.alias("conductor"), insulation.alias("insulation"), armour.alias("armour")), finish)
