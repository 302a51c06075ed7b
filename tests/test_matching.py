"""Known pairs -> verdicts, through the same projections the run uses."""
import pytest
from pyspark.sql import functions as F

from partweave.masters import DEFAULT_CONFIG, SUBSTITUTION_RULES
from partweave.operators.candidates import SIDE_COLUMNS, side
from partweave.operators.scoring import classify_match, fuse, route_match, score_pairs

from .helpers import records

# name -> (record A, record B, rules)
PUMP1 = "PUMP,CENT,50M3/HR,40MHD,7.5KW,FLP"
V150 = ("VALVE, GATE, 100NB, CLASS 150, A216 WCB, FLANGED RF, HANDWHEEL, API 600", {"org": "NTPC"})
V300 = ("VALVE, GATE, 100NB, CLASS 300, A216 WCB, FLANGED RF, HANDWHEEL, API 600", {"org": "CPCL"})
SKF = {"manufacturer": "SKF", "part_number": "6205-2RSH/C3"}
PAIRS = {
    "oem": (("BRG,DGBB,6205-2RS,C3", {**SKF, "org": "CPCL", "price": 420.0}),
            ("BRG,DGBB,6205-2RS,C3", {**SKF, "org": "NTPC", "price": 445.0})),
    "dialects": (("BEARING, BALL, DEEP GROOVE, 6205-2RS, C3 CLEARANCE, 25X52X15MM", {"uom": "NOS"}),
                 ("6205 2RS C3 BALL BRG", {"uom": "NO."})),
    "seal": ("BEARING, BALL, DEEP GROOVE, 6205-2RS, C3 CLEARANCE", "BEARING, BALL, DEEP GROOVE, 6205-ZZ, C3 CLEARANCE"),
    "size": ("BRG,DGBB,6205-2RS,C3", "BRG,DGBB,6206-2RS,C3"),
    "lean": ('Ball Valve 2"', "VALVE, BALL, 50NB, CLASS 150, A351 CF8M, FLANGED RF, API 6D"),
    "units": (PUMP1, "Centrifugal Pump 833 LPM 40m Head 10HP Flameproof CI"),
    "km": (("CBL,PWR,1.1KV,3.5CX95SQMM,AL,XLPE,ARMD", {"uom": "M"}),
           ("CABLE, POWER, 1.1KV, ALUMINIUM, XLPE, 3.5C X 95 SQ.MM, ARMOURED", {"uom": "KM"})),
    "noprice": ("BRG,DGBB,6205-2RS,C3", "BRG,DGBB,6205-2RS,C3"),
    "pressure": (V150, V300),
    "pn50": ('VLV,GT,4",150#,WCB,RF', "VALVE GATE DN100 PN50 WCB RF"),
    "noclass": (V150, "VALVE, GATE, 100NB, A216 WCB, FLANGED RF"),
    "pn20": (V150, "VALVE GATE DN100 PN20 WCB RF API 600"),
    "grade": ("VALVE, BALL, 50NB, CLASS 150, A351 CF8M, FLANGED RF, API 6D",
              "VALVE, BALL, 50NB, CLASS 150, A351 CF8, FLANGED RF, API 6D"),
    "voltage": ("CABLE, POWER, 11KV, ALUMINIUM, XLPE, 3C X 240 SQ.MM, STRIP ARMOURED",
                "CABLE, POWER, 6.6KV, ALUMINIUM, XLPE, 3C X 240 SQ.MM, STRIP ARMOURED"),
    "conductor": ("CABLE 1.1KV 2XWY 4CX16", "CABLE 1.1KV A2XWY 4CX16"),
    "fire": ("CBL,CTRL,1.1KV,12CX1.5SQMM,CU,PVC,ARMD,FRLS", "CBL,CTRL,1.1KV,12CX1.5SQMM,CU,PVC,ARMD,LSZH"),
    "flameproof": (PUMP1, "PUMP,CENT,50M3/HR,40MHD,7.5KW,TEFC"),
    "thread": ("BOLT, HEX HEAD, M20 X 80 MM, PROPERTY CLASS 8.8, HOT DIP GALVANISED", "HEX BOLT M20X1.5X80 CL 8.8 HDG"),
    "unified": ("STUD BOLT M16 X 110 MM A193 B7 BLACK", 'STUD BOLT 5/8"UNC X 110 A193 B7 BLACK'),
    "substitute": ("BOLT,HEX,M16X80,GR8.8,HDG", "BOLT,HEX,M16X80,GR10.9,HDG"),
}
VETO = {"size": "SIZE", "pressure": "PRESSURE_CLASS", "pn50": "PRESSURE_CLASS", "grade": "MATERIAL_GRADE",
        "voltage": "VOLTAGE", "conductor": "MATERIAL_GRADE", "fire": "CERTIFICATION", "flameproof": "CERTIFICATION",
        "thread": "THREAD", "unified": "THREAD"}


@pytest.fixture(scope="module")
def verdicts(spark):
    specs = [r for pair in PAIRS.values() for r in pair]
    recs = records(spark, specs).withColumns({
        "cnmc": F.lit(None).cast("string"), "copies": F.lit(1), "is_target": F.lit(True)}).select(*SIDE_COLUMNS)
    names = spark.createDataFrame([(n, f"rec-{2 * i:04d}", f"rec-{2 * i + 1:04d}") for i, n in enumerate(PAIRS)],
                                  "name string, a_record_id string, b_record_id string")
    pairs = names.join(side(recs, "a"), "a_record_id").join(side(recs, "b"), "b_record_id")
    out = {r["name"]: r for r in score_pairs(pairs).collect()}
    bare = {r["name"]: r for r in score_pairs(pairs.filter("name = 'substitute'"), rules=[]).collect()}
    return out, bare


def test_expected_vetoes(verdicts):
    out, _ = verdicts
    for name, r in out.items():
        kinds = [v["kind"] for v in r["vetoes"]]
        assert (VETO[name] in kinds) if name in VETO else not kinds, (name, kinds)
        if kinds:
            assert r["match_type"] == "RELATED_BUT_NOT_EQUIVALENT" and r["final_score"] <= 0.69
            assert r["routing"] == "NONE"
        assert len(r["reason_codes"]) > 3 and "attributes agree" in r["explanation"]


def test_verdicts(verdicts):
    out, bare = verdicts
    oem = out["oem"]
    assert oem["deterministic"] == "MPN_EXACT" and oem["match_type"] == "IDENTICAL" and oem["routing"] == "AUTO_QUEUE"
    assert oem["final_score"] >= 0.95
    assert {"DETERMINISTIC_MPN_MATCH", "CROSS_CPSE", "PRICE_CONSISTENT"} <= set(oem["reason_codes"])
    assert out["dialects"]["deterministic"] == "ATTRIBUTE_FINGERPRINT"
    assert out["dialects"]["match_type"] in ("DUPLICATE", "NEAR_DUPLICATE")
    assert out["dialects"]["components"]["uom"] == 1
    assert out["seal"]["match_type"] == "FUNCTIONALLY_EQUIVALENT"
    assert "ATTR_CONFLICT:SEAL_TYPE" in out["seal"]["reason_codes"]
    lean = out["lean"]
    assert lean["match_type"] == "INSUFFICIENT_DATA" and lean["routing"] == "UNRESOLVED"
    assert {"MISSING_REQUIRED:PRESSURE_CLASS", "MISSING_REQUIRED:BODY_MATERIAL"} <= set(lean["reason_codes"])
    status = {c["key"]: c["status"] for c in out["units"]["comparisons"]}
    assert status["flow_m3h"] == "MATCH" and status["motor_kw"] == "MATCH"
    assert "UOM_CONVERTIBLE" in out["km"]["reason_codes"] and out["km"]["components"]["uom"] == 0.9
    assert out["noprice"]["components"]["procurement"] is None and out["noprice"]["weights"]["procurement"] == 0
    assert "PROCUREMENT_HISTORY_UNAVAILABLE" in out["noprice"]["reason_codes"]
    pressure = out["pressure"]
    assert pressure["components"]["semantic"] > 0.85 and pressure["raw_score"] > 0.8
    assert "Pressure class differs (150 vs 300)" in pressure["explanation"]
    assert len(pressure["vetoes"]) == 1 and pressure["vetoes"][0]["a"] == "150"
    assert out["noclass"]["match_type"] == "INSUFFICIENT_DATA"
    assert out["pn20"]["match_type"] in ("IDENTICAL", "DUPLICATE", "NEAR_DUPLICATE")
    assert [v["rule"] for v in out["grade"]["vetoes"]] == ["VETO_MATERIAL_GRADE_MISMATCH"]
    sub = out["substitute"]
    assert "SUBSTITUTION_RULE_APPLIED:GRADE" in sub["reason_codes"] and sub["match_type"] == "FUNCTIONALLY_EQUIVALENT"
    assert [v["rule"] for v in bare["substitute"]["vetoes"]] == ["VETO_MATERIAL_GRADE_MISMATCH"]


def test_fusion_and_thresholds(spark):
    full = {k: F.lit(1.0) for k in DEFAULT_CONFIG.weights}
    full["procurement"] = F.lit(None).cast("double")
    strict = DEFAULT_CONFIG.with_(near_duplicate=0.95)
    no = F.lit(False)
    cm = lambda cfg: classify_match(F.lit(0.9), no, no, F.lit(None).cast("string"), no, no, cfg)
    row = spark.range(1).select(
        fuse(full)["score"].alias("a"), fuse(full)["weights"]["semantic"].alias("w"),
        fuse(full, DEFAULT_CONFIG.with_(missing_history="zero"))["score"].alias("z"),
        cm(DEFAULT_CONFIG).alias("near"), cm(strict).alias("strict"),
        *[route_match(F.lit(t), F.lit(s)).alias(f"r{i}") for i, (t, s) in enumerate([
            ("DUPLICATE", 0.97), ("NEAR_DUPLICATE", 0.9), ("FUNCTIONALLY_EQUIVALENT", 0.72),
            ("RELATED_BUT_NOT_EQUIVALENT", 0.8)])]).first()
    assert row.a == pytest.approx(1) and row.w == pytest.approx(0.316, abs=5e-4) and row.z == pytest.approx(0.95)
    assert (row.near, row.strict) == ("NEAR_DUPLICATE", "FUNCTIONALLY_EQUIVALENT")
    assert [row.r0, row.r1, row.r2, row.r3] == ["AUTO_QUEUE", "REVIEW", "UNRESOLVED", "NONE"]
    with pytest.raises(ValueError):
        DEFAULT_CONFIG.with_(functional=0.99)
