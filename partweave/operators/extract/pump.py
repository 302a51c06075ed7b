"""E5 - pump attributes."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions.expr import half_up, let
from .rules import attribute_map, captured, first_rule, make_attr, num_attr, prefixed_standard, text_attr

# Patterns and unit factors.
TYPES = [
    (r"SUBMERSIBLE", "SUBMERSIBLE"), (r"RECIPROCATING|DOSING|METERING|PLUNGER", "RECIPROCATING"),
    (r"\bGEAR PUMP\b|\bGEAR TYPE\b", "GEAR"), (r"\bSCREW PUMP\b|TWIN SCREW|PROGRESSIVE CAVITY", "SCREW"),
    (r"CENTRIFUGAL|END SUCTION|SPLIT CASE|\bOH2\b|\bBB1\b", "CENTRIFUGAL"),
]
FLOWS = [
    (r"(?<![0-9.])(\d+(?:\.\d+)?)\s*(?:M3/HR?|M³/HR?|CUM/HR?|CMH)\b", 1.0),
    (r"(?<![0-9.])(\d+(?:\.\d+)?)\s*LPM\b", 0.06),
    (r"(?<![0-9.])(\d+(?:\.\d+)?)\s*LPS\b", 3.6),
    (r"(?<![0-9.])(\d+(?:\.\d+)?)\s*(?:US\s*)?GPM\b", 0.2271),
    (r"(?<![0-9.])(\d+(?:\.\d+)?)\s*LPH\b", 0.001),
]
HEAD = (r"(?<![0-9.])(\d+(?:\.\d+)?)\s*(?:M|MTR|METRE|MWC|MLC)\s*(?:HEAD|TDH|HD)\b",
        r"(?:HEAD|TDH|\bH)\s*=?\s*(\d+(?:\.\d+)?)\s*(?:M|MTR|METRE|MWC)\b")
HEAD_FEET = r"(?<![0-9.])(\d+(?:\.\d+)?)\s*(?:FT|FEET)\s*(?:HEAD|TDH)?"
KILOWATT = r"(?<![0-9.])(\d+(?:\.\d+)?)\s*KW\b"
HORSEPOWER = r"(?<![0-9.])(\d+(?:\.\d+)?)\s*(?:HP|BHP)\b"
METRES_PER_FOOT, KW_PER_HP = 0.3048, 0.746
MATERIALS = [
    (r"\bCF8M\b|SS\s?316|STAINLESS STEEL\s*316", "SS316"), (r"\bCF8\b|SS\s?304|STAINLESS STEEL\s*304", "SS304"),
    (r"\bCA6NM\b|13\s?%?\s?CR", "CA6NM"), (r"CAST IRON|\bFG\s?260\b|\bCI\b", "CI"),
    (r"CARBON STEEL|CAST STEEL|\bWCB\b", "CS"), (r"BRONZE|GUN METAL", "BRONZE"),
]
ENCLOSURES = [
    (r"NON[\s-]*FLAMEPROOF|SAFE AREA|TOTALLY ENCLOSED FAN COOLED|\bTEFC\b", "TEFC"),
    (r"FLAMEPROOF|\bEX\s*-?\s*D\b|\bEXD\b|\bEX\s*DE?\s*IIB", "FLP"),
]
STANDARD = r"\b(API)\s*(610|674|675|676|685)\b|\b(ISO)\s*(5199|2858|9905)\b|\b(IS)\s*(5120|8034|9137)\b"
RPM = r"(?<![0-9.])(\d{3,4})\s*RPM\b"


def extract_pump(text: Column, manufacturer: Column) -> Column:
    ruled = lambda rules, conf, source: let(first_rule(text, rules), lambda r: text_attr(
        r["value"], conf, source, r["raw"]))
    measured = lambda patterns, conf, source, to_value: let(captured(text, *patterns), lambda m: num_attr(
        to_value(m["g1"].cast("double")), conf, source, m["raw"]))
    flow = F.coalesce(*[
        measured((p,), 0.95 if f == 1.0 else 0.9, "regex" if f == 1.0 else "derived",
                 lambda v, f=f: half_up(v * f, 2)) for p, f in FLOWS])
    head = F.coalesce(measured(HEAD, 0.94, "regex", lambda v: v),
                      measured((HEAD_FEET,), 0.85, "derived", lambda v: half_up(v * METRES_PER_FOOT, 1)))
    motor = F.coalesce(measured((KILOWATT,), 0.95, "regex", lambda v: v),
                       measured((HORSEPOWER,), 0.88, "derived", lambda v: half_up(v * KW_PER_HP, 2)))
    return attribute_map([
        ("pump_type", ruled(TYPES, 0.94, "dictionary")),
        ("flow_m3h", flow), ("head_m", head), ("motor_kw", motor),
        ("moc", ruled(MATERIALS, 0.9, "regex")), ("motor_enclosure", ruled(ENCLOSURES, 0.93, "regex")),
        ("design_standard", prefixed_standard(text, STANDARD, [("API", 2), ("ISO", 4), ("IS", 6)], 0.93)),
        ("speed_rpm", measured((RPM,), 0.9, "regex", lambda v: v)),
        ("manufacturer", make_attr(text, manufacturer)),
    ])
