"""Template codes and descriptions of canonical materials."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expr import code_number, let, lookup
from ..functions.text import code_segment
from .extract import value_num, value_text

# --------------------------------------------------------------------------------------------------------------
# Code abbreviations and description words
# --------------------------------------------------------------------------------------------------------------
BEARING_CODE = {"DEEP_GROOVE_BALL": "DGBB", "CYLINDRICAL_ROLLER": "CRB", "SPHERICAL_ROLLER": "SRB",
                "TAPER_ROLLER": "TRB", "ANGULAR_CONTACT_BALL": "ACBB"}
BEARING_WORDS = {"DEEP_GROOVE_BALL": "BALL, DEEP GROOVE", "CYLINDRICAL_ROLLER": "ROLLER, CYLINDRICAL",
                 "SPHERICAL_ROLLER": "ROLLER, SPHERICAL", "TAPER_ROLLER": "ROLLER, TAPERED",
                 "ANGULAR_CONTACT_BALL": "BALL, ANGULAR CONTACT"}
SEAL_WORDS = {"2RS": "DOUBLE SEALED 2RS", "ZZ": "DOUBLE SHIELDED ZZ", "OPEN": "OPEN"}
END_CODE = {"FLANGED_RF": "RF", "FLANGED_FF": "FF", "FLANGED_RTJ": "RTJ", "BUTT_WELD": "BW", "SOCKET_WELD": "SW",
            "SCREWED": "SCRD", "WAFER": "WFR", "LUG": "LUG", "FLANGED": "FLG"}
END_WORDS = {"FLANGED_RF": "FLANGED RF", "FLANGED_FF": "FLANGED FF", "FLANGED_RTJ": "FLANGED RTJ",
             "BUTT_WELD": "BUTT WELD ENDS", "SOCKET_WELD": "SOCKET WELD ENDS", "SCREWED": "SCREWED NPT",
             "WAFER": "WAFER TYPE", "LUG": "LUG TYPE", "FLANGED": "FLANGED"}
DN_TO_NPS = {"15": "1/2", "20": "3/4", "25": "1", "32": "1-1/4", "40": "1-1/2", "50": "2", "65": "2-1/2", "80": "3",
             "100": "4", "125": "5", "150": "6", "200": "8", "250": "10", "300": "12", "350": "14", "400": "16",
             "450": "18", "500": "20", "600": "24"}
BODY_WORDS = {"CS-WCB": "ASTM A216 WCB", "CS-WCC": "ASTM A216 WCC", "CS-A105": "ASTM A105", "SS316": "SS316 (CF8M)",
              "SS304": "SS304 (CF8)", "LTCS-LCB": "ASTM A352 LCB", "LTCS-LF2": "ASTM A350 LF2", "CI": "CAST IRON",
              "CS": "CARBON STEEL", "DI": "DUCTILE IRON"}
FASTENER_WORDS = {"HEX_BOLT": "BOLT, HEX HEAD", "STUD_BOLT": "STUD BOLT", "HEX_NUT": "NUT, HEX",
                  "WASHER": "WASHER, PLAIN", "SOCKET_HEAD_CAP_SCREW": "SCREW, SOCKET HEAD CAP", "SCREW": "SCREW"}
FASTENER_CODE = {"HEX_BOLT": "HXBOLT", "STUD_BOLT": "STUD", "HEX_NUT": "HXNUT", "WASHER": "WSHR",
                 "SOCKET_HEAD_CAP_SCREW": "SHCS", "SCREW": "SCRW"}
FINISH_CODE = {"HDG": "HDG", "ZINC_PLATED": "ZP", "PTFE_COATED": "PTFE", "BLACK": "BLK", "CADMIUM": "CD"}
PUMP_CODE = {"CENTRIFUGAL": "CENT", "SUBMERSIBLE": "SUBM", "RECIPROCATING": "RECP", "GEAR": "GEAR", "SCREW": "SCRW"}
CABLE_CODE = {"POWER": "PWR", "CONTROL": "CTL", "INSTRUMENTATION": "INS"}
ARMOUR_WORDS = {"WIRE": "STEEL WIRE ARMOURED", "STRIP": "STEEL STRIP ARMOURED", "UNARMOURED": "UNARMOURED",
                "ARMOURED": "ARMOURED"}
ARMOUR_CODE = {"WIRE": "SWA", "STRIP": "SSA", "UNARMOURED": "UNARM", "ARMOURED": "ARM"}
CONDUCTOR_WORDS = {"AL": "ALUMINIUM", "CU": "COPPER"}


def is_generic_of(generic: Column, specific: Column) -> Column:
    """M1 - compatible but less specific value ('CS' of 'CS-WCB', 'ARMOURED' of 'STRIP')."""
    return (generic != specific) & (
        specific.startswith(F.concat(generic, F.lit("-"))) | specific.startswith(F.concat(generic, F.lit("_")))
        | ((generic == "SS") & specific.rlike(r"^SS\d{3}"))
        | ((generic == "ARMOURED") & specific.isin("WIRE", "STRIP"))
    )


def merge_two(first: Column, second: Column) -> Column:
    """Merge rule of one key: keep the anchor, upgrade equal values by confidence, refine generic values."""
    up = lambda x: F.upper(x["value_text"])
    return (
        F.when(first.isNull(), second)
        .when(second.isNull(), first)
        .when((first["value_text"] == second["value_text"]) & (second["confidence"] > first["confidence"]), second)
        .when(is_generic_of(up(first), up(second)), second)
        .otherwise(first)
    )


def merge_attributes(first: Column, second: Column) -> Column:
    """G2 - merged attribute map of an anchor and one more record; the make is never part of the identity."""
    merged = F.map_zip_with(first, second, lambda k, a, b: merge_two(a, b))
    return F.map_filter(merged, lambda k, v: k != "manufacturer")


def override_attributes(attributes: Column, edits: Column) -> Column:
    """G13 - steward values win over merged ones."""
    return F.coalesce(F.map_zip_with(attributes, edits, lambda k, o, e: F.coalesce(e, o)), attributes)


def _dash(parts: list[Column]) -> Column:
    return F.array_join(F.array_compact(F.array(*parts)), "-")


def _comma(parts: list[Column]) -> Column:
    kept = F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != ""))
    return F.regexp_replace(F.array_join(kept, ", "), "_", " ")


def template_code(category: Column, attributes: Column) -> Column:
    """G3 - template code of a material, e.g. IN-MAT-BRG-DGBB-6205-C3-25X52X15."""

    def build(a: Column) -> Column:
        t = lambda k: value_text(a, k)
        n = lambda k, d="0": F.coalesce(code_number(value_num(a, k)), F.lit(d))
        coded = lambda table, k, d: F.coalesce(lookup(table, t(k)), F.lit(d))
        seg = lambda k, d=None: code_segment(t(k) if d is None else F.coalesce(t(k), F.lit(d)))
        head = lambda prefix: [F.lit("IN"), F.lit("MAT"), F.lit(prefix)]
        bearing = head("BRG") + [
            coded(BEARING_CODE, "bearing_type", "GEN"), seg("designation", "NA"),
            F.when(t("seal_type") != "OPEN", seg("seal_type")), seg("clearance"),
            F.when(value_num(a, "bore_mm") != 0, F.concat(
                n("bore_mm"), F.lit("X"), n("outer_diameter_mm"), F.lit("X"), n("width_mm")))]
        valve = head("VLV") + [
            seg("valve_type", "GEN"), F.concat(F.lit("DN"), F.coalesce(t("size_dn"), F.lit("NA"))),
            F.concat(F.lit("CL"), seg("pressure_class", "NA")), seg("body_material", "NA"),
            F.coalesce(lookup(END_CODE, t("end_connection")), seg("end_connection")),
            F.when(t("fire_safe") == "API 607", F.lit("FS"))]
        cable = head("CBL") + [
            coded(CABLE_CODE, "cable_type", "GEN"), F.concat(n("voltage_grade_kv"), F.lit("KV")),
            F.concat(n("cores"), F.lit("CX"), n("cross_section_sqmm")), seg("conductor", "NA"),
            seg("insulation", "NA"),
            F.when(t("armour").isNotNull(), coded(ARMOUR_CODE, "armour", "ARM")), seg("fire_performance")]
        length = F.when(value_num(a, "length_mm") != 0, F.concat(F.lit("X"), n("length_mm"))).otherwise(F.lit(""))
        fastener = head("FST") + [
            coded(FASTENER_CODE, "fastener_type", "GEN"), F.concat(seg("thread", "NA"), length), seg("grade", "NA"),
            F.coalesce(lookup(FINISH_CODE, t("finish")), seg("finish"))]
        pump = head("PMP") + [
            coded(PUMP_CODE, "pump_type", "GEN"), F.concat(n("flow_m3h"), F.lit("M3H")),
            F.concat(n("head_m"), F.lit("M")),
            F.when(value_num(a, "motor_kw") != 0, F.concat(n("motor_kw"), F.lit("KW"))), seg("moc"),
            F.when(t("motor_enclosure") == "FLP", F.lit("FLP"))]
        return (F.when(category == "BEARING", _dash(bearing)).when(category == "VALVE", _dash(valve))
                .when(category == "CABLE", _dash(cable)).when(category == "FASTENER", _dash(fastener))
                .when(category == "PUMP", _dash(pump)))

    return let(attributes, build)


def canonical_description(category: Column, attributes: Column) -> Column:
    """G4 - noun-modifier description of a material."""

    def build(a: Column) -> Column:
        t = lambda k: value_text(a, k)
        n = lambda k, d="?": F.coalesce(code_number(value_num(a, k)), F.lit(d))
        q = lambda k: F.coalesce(t(k), F.lit("?"))
        bearing = [
            F.lit("BEARING"), F.coalesce(lookup(BEARING_WORDS, t("bearing_type")), F.lit("GENERAL")), t("designation"),
            lookup(SEAL_WORDS, t("seal_type")), F.concat(t("clearance"), F.lit(" CLEARANCE")),
            F.when(value_num(a, "bore_mm") != 0, F.concat(
                n("bore_mm"), F.lit("X"), n("outer_diameter_mm"), F.lit("X"), n("width_mm"), F.lit("MM"))),
            F.concat(t("cage"), F.lit(" CAGE"))]
        valve = [
            F.lit("VALVE"), F.coalesce(t("valve_type"), F.lit("GENERAL")),
            F.concat(F.coalesce(lookup(DN_TO_NPS, t("size_dn")), F.lit("?")), F.lit("IN (DN"), q("size_dn"),
                     F.lit(")")),
            F.concat(F.lit("CLASS "), q("pressure_class")),
            F.coalesce(lookup(BODY_WORDS, t("body_material")), t("body_material")),
            F.coalesce(lookup(END_WORDS, t("end_connection")), t("end_connection")),
            F.when(t("operation") == "HANDWHEEL", F.lit("HANDWHEEL")).otherwise(
                F.concat(t("operation"), F.lit(" OPERATED"))),
            F.concat(F.lit("TRIM "), F.regexp_replace(t("trim"), "API TRIM ", "")),
            F.when(t("fire_safe") == "API 607", F.lit("FIRE SAFE API 607")), t("design_standard")]
        cable = [
            F.lit("CABLE"), F.coalesce(t("cable_type"), F.lit("GENERAL")), F.concat(n("voltage_grade_kv"), F.lit("KV")),
            F.concat(n("cores"), F.lit("C X "), n("cross_section_sqmm"), F.lit(" SQMM")),
            lookup(CONDUCTOR_WORDS, t("conductor")), t("insulation"), lookup(ARMOUR_WORDS, t("armour")),
            t("fire_performance"), t("standard")]
        fastener = [
            F.coalesce(lookup(FASTENER_WORDS, t("fastener_type")), F.lit("FASTENER")),
            F.concat(q("thread"), F.when(value_num(a, "length_mm") != 0, F.concat(
                F.lit(" X "), n("length_mm"), F.lit("MM"))).otherwise(F.lit(""))),
            F.concat(F.lit("GRADE "), q("grade")), F.regexp_replace(t("finish"), "_", " "), t("standard")]
        pump = [
            F.lit("PUMP"), F.coalesce(t("pump_type"), F.lit("GENERAL")),
            F.concat(n("flow_m3h"), F.lit(" M3/H @ "), n("head_m"), F.lit(" M HEAD")),
            F.when(value_num(a, "motor_kw") != 0, F.concat(n("motor_kw"), F.lit(" KW"))),
            F.when(t("motor_enclosure") == "FLP", F.lit("FLAMEPROOF MOTOR")).when(
                t("motor_enclosure").isNotNull(), F.lit("TEFC MOTOR")),
            F.concat(F.lit("MOC "), t("moc")), t("design_standard")]
        return (F.when(category == "BEARING", _comma(bearing)).when(category == "VALVE", _comma(valve))
                .when(category == "CABLE", _comma(cable)).when(category == "FASTENER", _comma(fastener))
                .when(category == "PUMP", _comma(pump)))

    return let(attributes, build)
