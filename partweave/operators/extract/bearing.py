"""E1 - bearing attributes."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions.expr import let, matched, str_array, str_map
from .rules import attribute_map, earliest_rule, make_attr, num_attr, text_attr

# Boundary dimensions d, D, B (mm) per ISO designation.
DIMENSIONS = {
    "6200": (10, 30, 9), "6201": (12, 32, 10), "6202": (15, 35, 11), "6203": (17, 40, 12), "6204": (20, 47, 14),
    "6205": (25, 52, 15), "6206": (30, 62, 16), "6207": (35, 72, 17), "6208": (40, 80, 18), "6209": (45, 85, 19),
    "6210": (50, 90, 20), "6211": (55, 100, 21), "6212": (60, 110, 22), "6304": (20, 52, 15), "6305": (25, 62, 17),
    "6306": (30, 72, 19), "6307": (35, 80, 21), "6308": (40, 90, 23), "6309": (45, 100, 25), "6310": (50, 110, 27),
    "6312": (60, 130, 31), "NU205": (25, 52, 15), "NU206": (30, 62, 16), "NU308": (40, 90, 23),
    "NU310": (50, 110, 27), "NJ308": (40, 90, 23), "NU312": (60, 130, 31), "22210": (50, 90, 23),
    "22212": (60, 110, 28), "22216": (80, 140, 33), "22220": (100, 180, 46), "22312": (60, 130, 46),
    "30205": (25, 52, 16.25), "30208": (40, 80, 19.75), "30210": (50, 90, 21.75), "32210": (50, 90, 24.75),
    "7205": (25, 52, 15), "7308": (40, 90, 23), "7310": (50, 110, 27),
}
# Patterns.
DESIGNATION = (r"(?<![A-Z0-9.])(NUP|NU|NJ)?\s?(6[0-3]\d{2}|[23]\d{2}|2[23][23]\d{2}|3[02][23]\d{2}|7[23]\d{2})"
               r"(?=[^0-9.]|$)")
TYPE_WORDS = [
    (r"DEEP GROOVE", "DEEP_GROOVE_BALL"), (r"SPHERICAL ROLLER", "SPHERICAL_ROLLER"),
    (r"CYLINDRICAL ROLLER", "CYLINDRICAL_ROLLER"), (r"TAPER ROLLER", "TAPER_ROLLER"),
    (r"ANGULAR CONTACT", "ANGULAR_CONTACT_BALL"),
]
TYPE_BY_DESIGNATION = [
    (r"^(NU|NJ|NUP)", "CYLINDRICAL_ROLLER"), (r"^6\d{3}$", "DEEP_GROOVE_BALL"),
    (r"^2[23][23]\d{2}$", "SPHERICAL_ROLLER"), (r"^3[02][23]\d{2}$", "TAPER_ROLLER"),
    (r"^7[23]\d{2}$", "ANGULAR_CONTACT_BALL"),
]
SIZE_TRIPLE = (r"(?<![0-9.])(\d{1,3}(?:\.\d+)?)\s*X\s*(\d{2,3}(?:\.\d+)?)\s*X\s*(\d{1,2}(?:\.\d+)?)\s*(?:MM)?"
               r"(?![0-9])")
SIZE_LABELS = (r"\bID\s*(\d{1,3}(?:\.\d+)?)\s*(?:MM)?\s+OD\s*(\d{2,3}(?:\.\d+)?)\s*(?:MM)?\s+(?:W|WIDTH|THK|B)\s*"
               r"(\d{1,2}(?:\.\d+)?)")
SEALS = [
    (r"(?<![A-Z])(2RS[1RHZ]?H?|DDU|LLU|2RZ)(?=C\d|[^A-Z]|$)", "2RS"),
    (r"DOUBLE (RUBBER )?SEAL(ED)?|SEALED BOTH SIDES|RUBBER SEALED", "2RS"),
    (r"(?<![A-Z])(ZZ|2ZR?|Z Z)(?=C\d|[^A-Z]|$)", "ZZ"),
    (r"DOUBLE SHIELD(ED)?|METAL SHIELD(ED)?", "ZZ"),
    (r"\bOPEN\b", "OPEN"),
]
CLEARANCES = [
    (r"(?:^|[^A-Z0-9]|DDU|LLU|RS1|RSH|RS|ZZ|2Z|[0-9])(C[2345])(?![A-Z0-9])", "C"),
    (r"\bCN\b|NORMAL CLEARANCE", "CN"),
]
CAGES = [
    (r"BRASS CAGE|MACHINED BRASS|(?<=\d)MA?\b", "BRASS"),
    (r"POLYAMIDE|TN9|TVH|NYLON CAGE", "POLYAMIDE"),
    (r"STEEL CAGE|PRESSED STEEL", "STEEL"),
]


def _designation(text: Column) -> Column:
    """Known designations are preferred over the first plausible one."""
    prefixes = F.regexp_extract_all(text, F.lit(DESIGNATION), F.lit(1))
    numbers = F.regexp_extract_all(text, F.lit(DESIGNATION), F.lit(2))
    known = str_array(DIMENSIONS)
    plausible = F.filter(
        F.zip_with(prefixes, numbers,
                   lambda p, n: F.when(F.length(p) > 0, F.concat(p, n)).when(F.length(n) >= 4, n)),
        lambda c: c.isNotNull())
    return let(plausible, lambda cs: F.coalesce(
        F.get(F.filter(cs, lambda c: F.array_contains(known, c)), F.lit(0)), F.get(cs, F.lit(0))))


def extract_bearing(text: Column, manufacturer: Column) -> Column:
    table = str_map({k: [float(n) for n in v] for k, v in DIMENSIONS.items()})

    def build(d: Column) -> Column:
        dims = F.try_element_at(table, d)
        derived = F.coalesce(*[F.when(d.rlike(p), F.lit(v)) for p, v in TYPE_BY_DESIGNATION])
        word = earliest_rule(text, TYPE_WORDS)
        bearing_type = F.coalesce(
            let(word, lambda w: text_attr(w["value"], 0.95, "dictionary", w["raw"])),
            text_attr(derived, F.when(text.contains("BALL") | ~derived.contains("BALL"), 0.88).otherwise(0.8),
                      "derived", d))

        def size(group: int, position: int) -> Column:
            explicit = [
                let(matched(text, p), lambda m, p=p: F.when(
                    m.isNotNull(), num_attr(F.regexp_extract(text, p, group), 0.95, "regex", m)))
                for p in (SIZE_TRIPLE, SIZE_LABELS)]
            return F.coalesce(*explicit, num_attr(F.get(dims, F.lit(position)), 0.9, "lookup", d))

        seal = F.coalesce(
            let(earliest_rule(text, SEALS), lambda s: text_attr(s["value"], 0.93, "regex", s["raw"])),
            F.when(d.isNotNull(), text_attr(F.lit("OPEN"), 0.72, "derived", "no seal suffix")))
        clearance = let(earliest_rule(text, CLEARANCES), lambda c: text_attr(
            F.when(c["value"] == "CN", F.lit("CN")).otherwise(matched(c["raw"], "(C[2345])", 1)),
            0.92, "regex", F.trim(c["raw"])))
        cage = let(earliest_rule(text, CAGES), lambda c: text_attr(c["value"], 0.8, "regex", c["raw"]))
        return attribute_map([
            ("designation", text_attr(d, F.when(dims.isNotNull(), 0.97).otherwise(0.8), "regex", d)),
            ("bearing_type", bearing_type),
            ("bore_mm", size(1, 0)), ("outer_diameter_mm", size(2, 1)), ("width_mm", size(3, 2)),
            ("seal_type", seal), ("clearance", clearance), ("cage", cage),
            ("manufacturer", make_attr(text, manufacturer)),
        ])

    return let(_designation(text), build)
