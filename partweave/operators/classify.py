"""Rule-based family classifier (C1-C5) as one column program."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expr import compact, half_up, let, matched

# --------------------------------------------------------------------------------------------------------------
# Weighted signals per family (pattern, weight, label), families in tie-break order
# --------------------------------------------------------------------------------------------------------------
SIGNALS = {
    "BEARING": [
        (r"\bBEARING\b", 4.0, "noun:BEARING"),
        (r"\b(DEEP GROOVE|SPHERICAL ROLLER|CYLINDRICAL ROLLER|TAPER ROLLER|ANGULAR CONTACT)\b", 2.0,
         "bearing-family keyword"),
        (r"(?<![A-Z0-9.])(6[0-3]\d{2}|NU\s?[23]\d{2}|NJ\s?[23]\d{2}|2[23][23]\d{2}|3[02][23]\d{2}|7[23]\d{2})"
         r"(?=[^0-9.]|$)", 2.0, "ISO bearing designation"),
        (r"(2RS|ZZ|2Z|DDU|LLU)\b|(?<![A-Z0-9])C[34](?![A-Z0-9])", 1.0, "seal/clearance suffix"),
    ],
    "VALVE": [
        (r"\bVALVE\b", 4.0, "noun:VALVE"),
        (r"\b(GATE|GLOBE|BUTTERFLY|CHECK|PLUG|NEEDLE)\b", 1.5, "valve-type keyword"),
        (r"\b(CLASS\s*\d{3,4}|\d{3,4}\s*(#|LBS?\b)|PN\s*\d{2,3})", 1.0, "pressure rating"),
        (r"\bAPI\s*(600|602|6D|609|594|608)\b|\bBS\s*(1873|1868|5352)\b", 1.5, "valve design standard"),
        (r"\b(WCB|A105|CF8M?|LCB)\b", 1.0, "valve body material"),
    ],
    "CABLE": [
        (r"\bCABLE\b", 4.0, "noun:CABLE"),
        (r"\b(SQMM|CORE|CORES)\b|\d\s*C(?:ORE)?\s*X\s*\d", 1.5, "conductor geometry"),
        (r"\b(CROSS LINKED POLYETHYLENE|XLPE|ARMOURED|UNARMOURED)\b", 1.0, "insulation/armour"),
        (r"\b\d+(\.\d+)?\s*KV\b|\b\d{3,5}\s*V\b", 1.0, "voltage grade"),
        (r"\bA?(2X|Y)(W|F)?Y\b", 2.0, "IS 7098 cable code"),
    ],
    "FASTENER": [
        (r"\b(BOLT|NUT|WASHER|STUD|SCREW)\b", 4.0, "noun:fastener"),
        (r"\bM\d{1,2}(\s*X\s*\d|\b)", 1.5, "metric thread"),
        (r"\b(8\.8|10\.9|12\.9|B7|2H|A193|A194)\b", 1.5, "fastener grade"),
        (r'\b\d(/\d)?"?\s*-?\s*(\d{1,2}\s*)?UNC\b', 1.5, "unified thread"),
    ],
    "PUMP": [
        (r"\bPUMP\b", 4.0, "noun:PUMP"),
        (r"\b(CENTRIFUGAL|SUBMERSIBLE|RECIPROCATING|DEWATERING|DOSING)\b", 1.5, "pump-type keyword"),
        (r"M3/H|\bLPM\b|\bGPM\b", 1.5, "flow unit"),
        (r"\bHEAD\b|\d\s*M\s*HD\b|\bTDH\b", 1.0, "head"),
    ],
}
SPARE_HEAD = (
    r"\b(IMPELLER|HOUSING|PLUMMER BLOCK|SPINDLE|SEAL KIT|GLAND|SLEEVE|SHAFT|COUPLING|GASKET|V-?BELT|BELT|GREASE|HOSE|"
    r"HELMET|GLOVES?|LUG|GLAND KIT|CABLE TIE|SPARES?|REPAIR KIT|O-?RING|DIAPHRAGM|BUSH)\b"
)
COMPOUND_SPARE = (
    r"\b(BEARING|VALVE|PUMP|CABLE)\s+(HOUSING|SPINDLE|SHAFT|IMPELLER|SEAL KIT|SPARES?|GLAND|SLEEVE|COUPLING|REPAIR KIT|"
    r"LUGS?|GLAND KIT|BUSH|TIES?|CASING|SEAT)\b"
)
FAMILY_NOUN = r"\b(BEARING|VALVE|CABLE|BOLT|NUT|STUD|WASHER|SCREW|PUMP)\b"
CONTEXT = r"\bFOR\b"
EVIDENCE_FLOOR = 3.5


def head_text(text: Column) -> Column:
    """C1 - the part of the description before the first FOR."""
    at = F.regexp_instr(text, F.lit(CONTEXT))
    return F.when(at > 1, F.substring(text, F.lit(1), at - 1)).otherwise(text)


def family_scores(head: Column, signals=None) -> Column:
    """C2 - array of struct(score, rank, category, labels); rank makes ties follow family order."""
    signals = signals or SIGNALS
    rows = []
    for i, (category, rules) in enumerate(signals.items()):
        labels = compact(*[F.when(head.rlike(p), F.lit(label)) for p, _, label in rules])
        weight_of = F.create_map(*[x for p, w, label in rules for x in (F.lit(label), F.lit(w))])
        rows.append(let(labels, lambda ls, i=i, category=category, weight_of=weight_of: F.struct(
            F.aggregate(ls, F.lit(0.0), lambda s, x: s + F.element_at(weight_of, x)).alias("score"),
            F.lit(-i).alias("rank"), F.lit(category).alias("category"), ls.alias("labels"))))
    return F.array(*rows)


def classify(text: Column, signals=None) -> Column:
    """struct(category, confidence, scores, reasons) of a normalised description."""

    def result(category, confidence, scores, reasons):
        return F.struct(category.alias("category"), confidence.alias("confidence"), scores.alias("scores"),
                        F.array_compact(reasons).alias("reasons"))

    def decide(head: Column) -> Column:
        context = F.when(
            head != text,
            F.concat(F.lit('context after "FOR" ignored: "'),
                     F.substring(text, F.length(head) + 1, F.lit(40)), F.lit('"')))

        def ranked(r: Column) -> Column:
            top, second = F.get(r, F.lit(0)), F.get(r, F.lit(1))
            scores = F.map_from_entries(F.transform(r, lambda x: F.struct(x["category"], x["score"])))
            compound = matched(head, COMPOUND_SPARE)
            spare = matched(head, SPARE_HEAD)
            has_noun = F.exists(top["labels"], lambda x: x.startswith("noun:"))
            spare_first = F.instr(head, spare) < F.regexp_instr(head, F.lit(FAMILY_NOUN))
            one = lambda c: F.format_string("%.1f", c)
            margin = (top["score"] - second["score"]) / top["score"]
            confidence = half_up(
                F.least(F.lit(0.99), F.lit(0.55) + 0.35 * margin + 0.02 * F.least(top["score"], F.lit(5.0))), 2)
            none = F.lit("UNCLASSIFIED")
            return (
                F.when(compound.isNotNull(), result(none, F.lit(0.85), scores, F.array(context, F.concat(
                    F.lit('compound noun "'), compound, F.lit('" denotes a component of a '),
                    F.lower(matched(head, COMPOUND_SPARE, 1)), F.lit(", not the item itself")))))
                .when(spare.isNotNull() & (~has_noun | spare_first), result(none, F.lit(0.8), scores, F.array(
                    context, F.concat(F.lit('head noun "'), spare,
                                      F.lit('" is a spare/consumable outside the five governed families')))))
                .when(top["score"] < EVIDENCE_FLOOR, result(
                    none, F.greatest(F.lit(0.2), top["score"] / 10), scores, F.array(context, F.concat(
                        F.lit("insufficient category evidence (best "), top["category"], F.lit(" = "),
                        one(top["score"]), F.lit(")")))))
                .otherwise(result(top["category"], confidence, scores, F.array(
                    context, F.concat(top["category"], F.lit(": "), F.array_join(top["labels"], ", ")),
                    F.when(second["score"] > 0, F.concat(F.lit("runner-up "), second["category"], F.lit(" ("),
                                                         one(second["score"]), F.lit(")"))))))
            )

        return let(F.sort_array(family_scores(head, signals), asc=False), ranked)

    return let(head_text(text), decide)
