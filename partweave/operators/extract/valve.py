"""E2 - valve attributes."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions.expr import let, lookup, matched, num_to_text
from ...functions.text import parse_inch
from .rules import (attribute_map, captured, earliest_rule, first_rule, make_attr, num_attr, prefixed_standard,
                    text_attr)

# Nominal pipe size (inch) to DN (mm), and PN ratings that correspond to pressure classes.
NPS_TO_DN = {
    "0.25": 8, "0.375": 10, "0.5": 15, "0.75": 20, "1": 25, "1.25": 32, "1.5": 40, "2": 50, "2.5": 65, "3": 80,
    "4": 100, "5": 125, "6": 150, "8": 200, "10": 250, "12": 300, "14": 350, "16": 400, "18": 450, "20": 500,
    "24": 600,
}
PN_TO_CLASS = {"20": "150", "50": "300", "68": "400", "100": "600", "150": "900", "250": "1500", "420": "2500"}
# Patterns.
TYPES = [(rf"\b{t}\b", t) for t in ("GATE", "GLOBE", "BALL", "CHECK", "BUTTERFLY", "PLUG", "NEEDLE")]
INCH = r'(?<![0-9./])(\d{1,2}[- ]\d/\d|\d/\d|\d{1,2}(?:\.\d{1,2})?)\s*(?:"|IN\b|INCH(?:ES)?\b|NPS\b)'
NOMINAL_BORE = (r"(?<![0-9.])(\d{2,4})\s*(?:MM\s*)?(?:NB\b|NOMINAL BORE)", r"(?:NB|NOMINAL BORE)\s*(\d{2,4})\b")
DN = r"\bDN\s*(\d{2,4})\b"
PRESSURE = (
    r"(?:CLASS|CL)\s*(150|300|400|600|800|900|1500|2500)\b",
    r"(?<![0-9.])(150|300|400|600|800|900|1500|2500)\s*(?:#|LBS?\b|LB\.)",
    r"\b(?:ANSI|ASME)\s*(150|300|600|900|1500)\b",
)
PN = r"\bPN\s*(\d{2,3})\b"
BODY = [
    (r"\bCF8M\b|A351\s*(?:GR(?:ADE)?\s*)?CF8M|\bF316L?\b|SS\s?316L?\b|STAINLESS STEEL\s*316", "SS316"),
    (r"\bCF8\b|A351\s*(?:GR(?:ADE)?\s*)?CF8\b|\bF304L?\b|SS\s?304L?\b|STAINLESS STEEL\s*304", "SS304"),
    (r"\bWCC\b", "CS-WCC"), (r"\bWCB\b", "CS-WCB"), (r"\bA\s?105N?\b", "CS-A105"), (r"\bLCB\b|A352", "LTCS-LCB"),
    (r"\bLF2\b|A350", "LTCS-LF2"), (r"\bF11\b|\bWC6\b", "AS-WC6"), (r"DUCTILE IRON|SG IRON", "DI"),
    (r"CAST IRON|\bIS\s*210\b|\bFG\s?260\b", "CI"), (r"GUN METAL|BRONZE", "BRONZE"),
    (r"CARBON STEEL|CAST STEEL|FORGED STEEL|\bSTEEL BODY\b", "CS"), (r"STAINLESS STEEL", "SS"),
]
ENDS = [
    (r"RAISED FACE|\bRF\b", "FLANGED_RF"), (r"FLAT FACE|\bFF\b", "FLANGED_FF"),
    (r"RING TYPE JOINT|\bRTJ\b", "FLANGED_RTJ"), (r"BUTT WELD", "BUTT_WELD"), (r"SOCKET WELD", "SOCKET_WELD"),
    (r"SCREWED|THREADED|\bNPT\b|\bBSP\b", "SCREWED"), (r"\bWAFER\b", "WAFER"), (r"\bLUG(GED)? TYPE\b", "LUG"),
    (r"FLANGED|\bFLG\b", "FLANGED"),
]
OPERATIONS = [
    (r"GEAR OPERATED|GEAR BOX|GEARBOX|BEVEL GEAR", "GEAR"),
    (r"MOTOR OPERATED|ACTUATOR|PNEUMATIC|ELECTRIC ACTUATED", "ACTUATED"),
    (r"LEVER", "LEVER"), (r"HANDWHEEL|HAND WHEEL", "HANDWHEEL"),
]
STANDARD = (r"\b(API)\s*(600|602|6D|609|594|608|623|598)\b|\b(BS)\s*(1873|1868|5352|5351|5153)\b|"
            r"\b(IS)\s*(14846|778|13095)\b")
TRIMS = [(r"\bTRIM\s*(?:NO\.?\s*)?(\d{1,2})\b", "TRIM"), (r"13\s?%?\s?CR\b", "13CR"),
         (r"STELLITE|HARD ?FACED", "STELLITE")]
FIRE = [(r"NON[\s-]*FIRE[\s-]*SAFE", "NONE"), (r"FIRE[\s-]*SAFE|API\s*607|API\s*6FA", "API 607")]


def extract_valve(text: Column, manufacturer: Column) -> Column:
    valid = [float(v) for v in NPS_TO_DN.values()]

    def sized(match: Column, confidence: float) -> Column:
        return let(match, lambda m: F.when(
            m["g1"].cast("double").isin(valid), num_attr(m["g1"], confidence, "regex", m["raw"])))

    from_inch = let(captured(text, INCH), lambda m: num_attr(
        lookup(NPS_TO_DN, num_to_text(parse_inch(m["g1"]))), 0.93, "regex", m["raw"]))
    size = F.coalesce(sized(captured(text, DN), 0.97), sized(captured(text, *NOMINAL_BORE), 0.95), from_inch)

    def from_pn(m: Column) -> Column:
        cls = lookup(PN_TO_CLASS, m["g1"])
        return F.coalesce(text_attr(cls, 0.9, "lookup", m["raw"]),
                          text_attr(F.concat(F.lit("PN"), m["g1"]), 0.85, "regex", m["raw"]))

    pressure = F.coalesce(
        let(captured(text, *PRESSURE), lambda m: text_attr(m["g1"], 0.96, "regex", m["raw"])),
        let(captured(text, PN), from_pn))

    def rated(rule: Column, confidence, source="regex") -> Column:
        return let(rule, lambda r: text_attr(
            r["value"], confidence(r) if callable(confidence) else confidence, source, r["raw"]))

    trim = let(first_rule(text, TRIMS), lambda r: text_attr(
        F.when(r["value"] == "TRIM", F.concat(F.lit("API TRIM "), matched(r["raw"], r"(\d{1,2})", 1)))
        .otherwise(r["value"]), 0.85, "regex", r["raw"]))
    return attribute_map([
        ("valve_type", rated(earliest_rule(text, TYPES), 0.95, "dictionary")),
        ("size_dn", size),
        ("pressure_class", pressure),
        ("body_material", rated(first_rule(text, BODY),
                                lambda r: F.when(r["value"].isin("CS", "SS"), 0.6).otherwise(0.94))),
        ("end_connection", rated(first_rule(text, ENDS),
                                 lambda r: F.when(r["value"] == "FLANGED", 0.7).otherwise(0.93))),
        ("operation", rated(first_rule(text, OPERATIONS), 0.9)),
        ("design_standard", prefixed_standard(text, STANDARD, [("API", 2), ("BS", 4), ("IS", 6)], 0.95)),
        ("trim", trim),
        ("fire_safe", rated(first_rule(text, FIRE), 0.93)),
        ("manufacturer", make_attr(text, manufacturer)),
    ])
