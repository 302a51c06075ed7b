"""The whole match run against every pair of a small set of records, selected in plain Python."""
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from partweave.masters import DEFAULT_CONFIG, POSITIVE
from partweave.operators.candidates import SIDE_COLUMNS, side
from partweave.operators.scoring import score_pairs
from partweave.operators.selection import OPEN
from partweave.plans.matching import run_matching
from partweave.session import cut_lineage

from .helpers import records

SPECS = [
    "BRG,DGBB,6205-2RS,C3", ("BEARING, BALL, DEEP GROOVE, 6205-2RS, C3 CLEARANCE", {"org": "NTPC"}), ("6205 2RS C3 BALL BRG", {"org": "BHEL"}),
    ("BRG,DGBB,6205-ZZ,C3", {"org": "NTPC"}), "BRG,DGBB,6206-2RS,C3", ("Ball Bearing 6206", {"org": "NTPC"}),
    "VALVE, GATE, 100NB, CLASS 150, A216 WCB, FLANGED RF, HANDWHEEL, API 600", ("VALVE GATE DN100 PN20 WCB RF API 600", {"org": "NTPC"}),
    ("VALVE, GATE, 100NB, CLASS 300, A216 WCB, FLANGED RF, HANDWHEEL, API 600", {"org": "CPCL"}), ("Gate Valve 4\"", {"org": "BHEL"}),
    ("VALVE, GATE, 100NB, A216 WCB, FLANGED RF", {"org": "NTPC"}), "BOLT,HEX,M16X80,GR8.8,HDG", ("BOLT,HEX,M16X80,GR10.9,HDG", {"org": "NTPC"}),
    ("HEX BOLT M16X80 CL 8.8 HDG", {"org": "BHEL"}), ("HEX BOLT M16X80 CL 8.8 HDG", {"org": "BHEL"}), "GASKET GREEN 17", ("GASKET RED 18", {"org": "NTPC"}),
]
CODES = {1: "IN-A", 3: "IN-A", 12: "IN-B"}
name = lambda i: f"rec-{i:04d}"


@pytest.fixture(scope="module")
def run(spark):
    config = DEFAULT_CONFIG.with_(knn=2)
    recs = cut_lineage(records(spark, SPECS))
    mapped = spark.createDataFrame([(name(i), c, "ACTIVE") for i, c in CODES.items()] + [(name(6), "IN-OLD", "REVERSED")],
                                   "record_id string, cnmc string, status string")
    # Records of no family are never matched.
    known = recs.filter("category <> 'UNCLASSIFIED'").drop("cnmc")
    sides = known.join(mapped.filter("status = 'ACTIVE'").select("record_id", "cnmc"), "record_id", "left").withColumns(
        {"copies": F.lit(1), "is_target": F.lit(True)}).select(*SIDE_COLUMNS)
    pairs = side(sides, "a").join(side(sides, "b"), F.col("a_record_id") < F.col("b_record_id")).withColumn(
        "pair_key", F.concat_ws("::", "a_record_id", "b_record_id")).filter("a_category = b_category")
    scored = {r["pair_key"]: r.asDict(recursive=True) for r in score_pairs(cut_lineage(pairs), config).collect()}
    existing = spark.createDataFrame([(f"{name(0)}::{name(2)}", "REJECTED"), (f"{name(0)}::{name(4)}", "PENDING")], "pair_key string, status string")
    out = run_matching(recs, config, mappings=mapped, existing=existing)
    return {r["record_id"]: r for r in sides.collect()}, scored, existing.collect(), out


def expected(rows, scored, existing):
    ident = lambda r: tuple(str(r[c]) for c in SIDE_COLUMNS if c not in ("record_id", "embedding", "fingerprint"))
    first = {}
    for i in sorted(rows):
        first.setdefault(ident(rows[i]), i)
    kinds = sorted(first.values())
    unit = {i: np.array(rows[i]["embedding"], float) for i in kinds}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items() if v.any()}
    wanted = {f"{first[ident(rows[i])]}::{i}" for i in rows if first[ident(rows[i])] != i}
    for i in kinds:
        peers = [j for j in kinds if j != i and rows[j]["category"] == rows[i]["category"]]
        wanted |= {f"{min(i, j)}::{max(i, j)}" for j in peers if rows[i]["block_key"] is not None and rows[i]["block_key"] == rows[j]["block_key"]}
        near = sorted((round(-float(unit[i] @ unit[j]), 9), j) for j in peers if i in unit and j in unit)[:2]
        wanted |= {f"{min(i, j)}::{max(i, j)}" for _, j in near}
    pool = {k: scored[k] for k in wanted}
    order = lambda p: (-p["raw_score"], p["pair_key"])
    related = lambda p: p["match_type"] == "RELATED_BUT_NOT_EQUIVALENT"
    stored = {k for k, p in pool.items() if p["match_type"] in (*POSITIVE, "FUNCTIONALLY_EQUIVALENT") or related(p) and (
        p["raw_score"] >= 0.72 and any(v["kind"] != "SIZE" for v in p["vetoes"]) if p["vetoes"] else p["raw_score"] >= 0.62)}
    for i in rows:
        lean = [p for p in pool.values() if p["match_type"] == "INSUFFICIENT_DATA" and any(
            p[f"{s}_record_id"] == i and p[f"{s}_missing_required"] for s in "ab")]
        stored |= {p["pair_key"] for p in sorted(lean, key=order)[:3]}
    covered = {x for k in stored for x in k.split("::")}
    for i in set(kinds) - covered:
        mine = sorted((p for p in pool.values() if i in p["pair_key"].split("::")), key=order)
        stored |= {p["pair_key"] for p in mine[:1]}
    led = {}
    for k in stored:
        p = pool[k]
        if not p["vetoed"] and (p["a_cnmc"] is None) != (p["b_cnmc"] is None):
            led.setdefault((p["a_record_id"] if p["a_cnmc"] is None else p["b_record_id"], p["a_cnmc"] or p["b_cnmc"]), []).append(
                (-p["final_score"], k))
    dropped = {k for held in led.values() for _, k in sorted(held)[1:]}
    counted = stored - dropped
    decided = {r["pair_key"] for r in existing if r["status"] not in OPEN}
    final = {k for k in counted - decided if pool[k]["a_cnmc"] is None or pool[k]["a_cnmc"] != pool[k]["b_cnmc"]}
    counts = Counter(("match_type", pool[k]["match_type"]) for k in counted) + Counter(
        ("veto", v["rule"]) for k in counted for v in pool[k]["vetoes"])
    return pool, final, dropped, counts


def test_run_equals_all_pairs(run):
    rows, scored, existing, out = run
    pool, final, dropped, counts = expected(rows, scored, existing)
    got = {r["pair_key"]: r for r in out.recommendations.collect()}
    assert set(got) == final and len(final) > 8
    for k, r in got.items():
        assert r["match_type"] == pool[k]["match_type"] and r["final_score"] == pytest.approx(pool[k]["final_score"], abs=1e-9)
        assert r["reason_codes"] == pool[k]["reason_codes"] and r["routing"] == pool[k]["routing"]
        anchor = r["a_cnmc"] or r["b_cnmc"]
        lean = pool[k]["a_missing_required"] or pool[k]["b_missing_required"]
        assert r["proposed_cnmc"] == anchor if anchor else (r["proposed_cnmc"] is None) == bool(lean)
    assert sorted(r["pair_key"] for r in out.dropped.collect()) == sorted(dropped) and dropped
    assert {(r["kind"], r["key"]): r["n"] for r in out.statistics.collect()} == counts
    queued = {r["pair_key"] for r in out.tasks.collect()}
    assert queued == {k for k in final if pool[k]["routing"] != "NONE"}
    assert len({pool[k]["match_type"] for k in final}) >= 4
