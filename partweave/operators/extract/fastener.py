"""E4 - fastener attributes."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions.expr import let, lookup, matched, num_to_text
from ...functions.text import parse_inch
from .rules import attribute_map, captured, first_rule, num_attr, prefixed_standard, text_attr

# Coarse pitch per metric diameter, threads per inch per unified diameter, inch fractions.
COARSE_PITCH = {
    "3": 0.5, "4": 0.7, "5": 0.8, "6": 1.0, "8": 1.25, "10": 1.5, "12": 1.75, "14": 2.0, "16": 2.0, "18": 2.5,
    "20": 2.5, "22": 2.5, "24": 3.0, "27": 3.0, "30": 3.5, "36": 4.0,
}
UNC_TPI = {"0.5": "13", "0.625": "11", "0.75": "10", "0.875": "9", "1": "8"}
FRACTION_TEXT = {"0.5": "1/2", "0.625": "5/8", "0.75": "3/4", "0.875": "7/8", "0.25": "1/4", "0.375": "3/8",
                 "0.125": "1/8"}
# Patterns.
TYPES = [
    (r"STUD BOLT|\bSTUDS?\b", "STUD_BOLT"),
    (r"SOCKET HEAD CAP SCREW|ALLEN (BOLT|SCREW)", "SOCKET_HEAD_CAP_SCREW"),
    (r"\bBOLT\b", "HEX_BOLT"), (r"\bNUT\b", "HEX_NUT"), (r"\bWASHER\b", "WASHER"), (r"\bSCREW\b", "SCREW"),
]
METRIC = r"(?<![A-Z0-9])M(\d{1,2})((?:\s*X\s*\d{1,3}(?:\.\d{1,2})?)*)"
UNIFIED = (r'(?<![0-9./])(\d-\d/\d|\d/\d|\d(?:\.\d+)?)\s*(?:"|\s*INCH(?:ES)?)?\s*(?:-\s*(\d{1,2})\s*)?'
           r"(UNC|UNF|8\s?UN|BSW)(?=X|\b)")
BARE_INCH = r'(?<![0-9./])(\d-\d/\d|\d/\d|1)\s*"\s*(?:DIA(?:METER)?)?\s*X\s*(\d{2,3})'
AFTER_SERIES = r'^.*?(UNC|UNF|8\s?UN|")'
LENGTH_MARKED = r"(?:X|LENGTH|LG)\s*(\d{2,3})\s*(?:MM)?\s*(?:LG|LONG|LENGTH)?\b"
LENGTH_MM = r"(\d{2,3})\s*MM\s*(?:LG|LONG|LENGTH)"
GRADES = [
    (r"A193\s*(?:GRADE\s*|GR\s*)?(B7M|B7|B8M|B8|B16)\b", "A193"),
    (r"(?<![A-Z0-9])(B7M|B7|B8M|B16)(?![A-Z0-9])", "A193"),
    (r"A194\s*(?:GRADE\s*|GR\s*)?(2HM|2H|8M|7)\b", "A194"),
    (r"(?<![0-9.])(4\.6|4\.8|8\.8|10\.9|12\.9)(?![0-9])", "PC"),
    (r"SS\s?316|STAINLESS STEEL\s*316|\bA4[-\s]?(70|80)\b", "SS316"),
    (r"SS\s?304|STAINLESS STEEL\s*304|\bA2[-\s]?(70|80)\b", "SS304"),
    (r"(?:GRADE|GR\.?|PROPERTY CLASS|CLASS)\s*(8|10|12)\b", "NUTPC"),
]
FINISHES = [
    (r"HOT DIP GALVANISED|\bHDG\b", "HDG"), (r"ZINC PLATED|ELECTRO ?GALVANISED|\bEG\b", "ZINC_PLATED"),
    (r"PTFE|XYLAN|FLUOROCARBON", "PTFE_COATED"), (r"CADMIUM", "CADMIUM"), (r"\bGALVANISED\b", "HDG"),
    (r"\bBLACK\b|\bPLAIN\b|UNCOATED", "BLACK"),
]
STANDARD = (r"\b(IS)\s*(1363|1364|1367|6639|2016|3063)\b|\b(ASTM)\s*(A193|A194|A320|F436)\b|"
            r"\b(DIN)\s*(931|933|934|975)\b|\b(ISO)\s*(4014|4017|4032)\b")


def _inch_text(v: Column) -> Column:
    whole = F.floor(v).cast("int")
    frac = F.coalesce(lookup(FRACTION_TEXT, num_to_text(v - F.floor(v))), F.lit(""))
    return (F.when((whole > 0) & (frac != ""), F.concat(whole.cast("string"), F.lit("-"), frac))
            .when(whole > 0, whole.cast("string")).otherwise(frac))


def _metric(text: Column) -> Column:
    dia = F.regexp_extract(text, METRIC, 1).cast("int").cast("string")
    numbers = F.transform(F.regexp_extract_all(F.regexp_extract(text, METRIC, 2), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)),
                          lambda s: s.cast("double"))
    raw = matched(text, METRIC)

    def build(n: Column) -> Column:
        stated = F.get(F.filter(n, lambda x: x <= 4), F.lit(0))
        length = F.get(F.filter(n, lambda x: x >= 5), F.lit(0))
        pitch = F.coalesce(stated, lookup(COARSE_PITCH, dia))
        pitch_text = F.when(pitch == F.floor(pitch), F.concat(num_to_text(pitch), F.lit(".0"))).otherwise(
            num_to_text(pitch))
        return F.struct(
            text_attr(F.concat(F.lit("M"), dia), 0.97, "regex", raw).alias("thread_size"),
            text_attr(F.concat(F.lit("M"), dia, F.lit("X"), pitch_text),
                      F.when(stated.isNotNull(), 0.97).otherwise(0.88),
                      F.when(stated.isNotNull(), "regex").otherwise("lookup"), raw).alias("thread"),
            num_attr(length, 0.93, "regex", raw).alias("length_mm"))

    return let(numbers, build)


def _inch(text: Column) -> Column:
    unified = matched(text, UNIFIED)
    is_unified = unified.isNotNull()
    g = lambda i: F.regexp_extract(text, UNIFIED, i)
    raw = F.coalesce(unified, matched(text, BARE_INCH))
    dia = parse_inch(F.when(is_unified, g(1)).otherwise(F.regexp_extract(text, BARE_INCH, 1)))

    def build(d: Column) -> Column:
        series = F.when(is_unified, F.regexp_replace(g(3), r"\s", "")).when(d > 1, F.lit("8UN")).otherwise(
            F.lit("UNC"))
        tpi = F.coalesce(F.when(is_unified, F.nullif(g(2), F.lit("")).cast("int").cast("string")),
                         F.when(series == "8UN", F.lit("8")).otherwise(lookup(UNC_TPI, num_to_text(d))), F.lit("?"))
        length = captured(F.regexp_replace(text, AFTER_SERIES, ""), LENGTH_MARKED)
        length = F.coalesce(length, captured(text, LENGTH_MM))
        return F.struct(
            text_attr(F.concat(_inch_text(d), F.lit("IN")), 0.9, "regex", raw).alias("thread_size"),
            text_attr(F.concat(_inch_text(d), F.lit("-"), tpi, series), F.when(is_unified, 0.93).otherwise(0.7),
                      F.when(is_unified, "regex").otherwise("derived"), raw).alias("thread"),
            let(length, lambda m: num_attr(m["g1"], 0.85, "regex", m["raw"])).alias("length_mm"))

    return let(F.when(raw.isNotNull(), dia), build)


def extract_fastener(text: Column) -> Column:
    def graded(r: Column) -> Column:
        inside = lambda p: matched(r["raw"], p, 1)
        value = (
            F.when(r["value"] == "A193", F.concat(F.lit("A193-"), inside("(B7M|B7|B8M|B8|B16)")))
            .when(r["value"] == "A194", F.concat(F.lit("A194-"), inside(r"(2HM|2H|8M|7)\b")))
            .when(r["value"] == "PC", inside(r"(4\.6|4\.8|8\.8|10\.9|12\.9)"))
            .when(r["value"] == "NUTPC", F.concat(F.lit("PC"), inside(r"(8|10|12)\b")))
            .otherwise(r["value"]))
        return text_attr(value, 0.94, "regex", r["raw"])

    sizes = F.when(text.rlike(METRIC), _metric(text)).otherwise(_inch(text))
    return let(sizes, lambda s: attribute_map([
        ("fastener_type", let(first_rule(text, TYPES), lambda r: text_attr(r["value"], 0.95, "dictionary", r["raw"]))),
        ("thread_size", s["thread_size"]), ("thread", s["thread"]), ("length_mm", s["length_mm"]),
        ("grade", let(first_rule(text, GRADES), graded)),
        ("finish", let(first_rule(text, FINISHES), lambda r: text_attr(
            r["value"], F.when(r["raw"] == "GALVANISED", 0.7).otherwise(0.92), "dictionary", r["raw"]))),
        ("standard", prefixed_standard(text, STANDARD, [("IS", 2), ("ASTM", 4), ("DIN", 6), ("ISO", 8)], 0.9)),
    ]))
