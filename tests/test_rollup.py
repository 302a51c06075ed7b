"""Kept sums against the dashboard over whole tables, metrics of a write, and the fan-out export."""
import json
import random

import pytest
from pyspark.sql import functions as F

from partweave.operators import selection
from partweave.operators.extract.rules import MAP_TYPE
from partweave.plans import dashboard as D
from partweave.plans.observed import stage_measures, statistics_metrics, statistics_rows, write_observed
from partweave.plans.rollup import Rollup
from partweave.sources.export import export_delta, export_fanout, org_documents

RECORDS = ("record_id string, org string, category string, completeness double, flags array<string>, missing_required array<string>, "
           "expansions array<string>, cnmc string, price double, qty double")
PAIRS = ("pair_key string, a_record_id string, b_record_id string, a_org string, b_org string, category string, match_type string, "
         "vetoed boolean, status string, decided_at date, waiting boolean")
CANONICAL = "cnmc string, category string, status string"


def rows(frame, digits=6):
    cut = lambda v: round(v, digits) if isinstance(v, float) else v
    return sorted((tuple(cut(r[c]) for c in sorted(frame.columns)) for r in frame.collect()), key=str)


class World:
    """Tables that change row by row; the dashboard reads them whole."""

    def __init__(self, seed):
        self.draw = random.Random(seed)
        self.records, self.pairs, self.canonical, self.events = {}, {}, {}, 0

    def record(self, i):
        d = self.draw
        return (f"r{i}", d.choice(["A", "B", "C", None]), d.choice(["VALVE", "PUMP", "UNCLASSIFIED"]), d.choice([0.25, 0.5, 0.99]),
                d.choice([["UOM_MISSING"], ["MISSING_REQUIRED:X", "MISSING_REQUIRED:Y"], []]), d.choice([["x"], []]), d.choice([["A"], [], ["A", "B"]]),
                d.choice([None, "M1", "M2", "M3"]), d.choice([None, 0.0, 1.5, 2.25, 9.75]), float(d.randint(1, 9)))

    def pair(self, i):
        d = self.draw
        status = d.choice(["PENDING", "APPROVED", "REJECTED"])
        return (f"p{i}", f"r{d.randrange(40)}", f"r{d.randrange(40)}", d.choice(["A", "B"]), d.choice(["A", "C", None]), d.choice(["VALVE", "PUMP"]),
                d.choice(D.MATCH_TYPE_ORDER), d.random() < 0.2, status, None, status == "PENDING")

    def step(self):
        """Changed rows of each table, before and after."""
        after, before = {}, {}
        for name, table, make in (("records", self.records, self.record), ("pairs", self.pairs, self.pair)):
            keys = [self.draw.randrange(60) for _ in range(15)]
            old = [table[k] for k in set(keys) if k in table]
            for k in set(keys):
                table[k] = make(k)
            after[name], before[name] = [table[k] for k in set(keys)], old
            gone = [k for k in list(table) if k not in keys][:2]
            before[name] += [table.pop(k) for k in gone]
        code = self.draw.choice(["M1", "M2", "M3"])
        before["canonical"] = [self.canonical[code]] if code in self.canonical else []
        self.canonical[code] = (code, "VALVE", self.draw.choice(["APPROVED", "RETIRED"]))
        after["canonical"] = [self.canonical[code]]
        return after, before


@pytest.mark.parametrize("seed", [1])
def test_rollup_equals_the_dashboard_after_every_batch(spark, tmp_path, seed):
    world, kept = World(seed), Rollup(spark, f"{tmp_path}/rollup", buckets=8)
    schema = {"records": RECORDS, "pairs": PAIRS, "canonical": CANONICAL}
    frames = lambda part: {n: spark.createDataFrame(v, schema[n]) for n, v in part.items()}
    for turn in range(4):
        after, before = world.step()
        assert kept.add(f"b{turn}", frames(after), frames(before))
    version = kept.table.version()
    assert not kept.add("b3", frames(after)) and kept.table.version() == version

    norm = raw = spark.createDataFrame(list(world.records.values()), RECORDS)
    recs = spark.createDataFrame(list(world.pairs.values()), PAIRS)
    canonical = spark.createDataFrame(list(world.canonical.values()), CANONICAL)
    mappings = raw.filter("cnmc is not null").select("record_id", "cnmc", "org", F.lit("ACTIVE").alias("status"))
    tasks = recs.filter("waiting").select("pair_key", F.lit("OPEN").alias("status"))
    orgs = spark.createDataFrame([("A",), ("B",), ("C",), ("Z",)], "org string")
    events = raw.limit(0)
    assert rows(kept.kpi_totals()) == rows(D.kpi_totals(raw, norm, recs, tasks, mappings, canonical, events))
    assert rows(kept.category_breakdown()) == rows(D.category_breakdown(norm, mappings, canonical, recs, tasks))
    assert rows(kept.match_type_histogram()) == rows(D.match_type_histogram(recs))
    assert rows(kept.flag_histogram()) == rows(D.flag_histogram(norm))
    assert rows(kept.funnel()) == rows(D.funnel(raw, norm, recs, mappings))
    assert rows(kept.opportunities(min_orgs=1)) == rows(D.opportunities(canonical, mappings, raw, min_orgs=1))
    mine = {r["org"]: r for r in kept.org_scorecard(orgs).collect()}
    whole = D.org_scorecard(orgs, raw.drop("cnmc"), norm, mappings, recs.filter("false"), tasks)
    for r in whole.collect():
        assert all(mine[r["org"]][c] == r[c] for c in ("records", "mapped", "completeness", "uom_issues"))
    touching = {o: {p[0] for p in world.pairs.values() if p[10] and o in (p[3], p[4])} for o in "ABCZ"}
    assert {o: r["pending"] for o, r in mine.items()} == {o: len(p) for o, p in touching.items()}


def test_timeline_from_kept_sums(spark, tmp_path):
    from datetime import date

    kept, pair = Rollup(spark, f"{tmp_path}/rollup", buckets=4), lambda i, s, d: (f"p{i}", "a", "b", "A", "B", "PUMP", "DUPLICATE", False, s, d, False)
    first = [pair(1, "APPROVED", date(2024, 1, 30)), pair(2, "REJECTED", date(2024, 1, 30)), pair(3, "PENDING", None)]
    moved = [pair(1, "REJECTED", date(2024, 1, 31))]
    kept.add("one", {"pairs": spark.createDataFrame(first, PAIRS)})
    kept.add("two", {"pairs": spark.createDataFrame(moved, PAIRS)}, {"pairs": spark.createDataFrame(first[:1], PAIRS)})
    whole = D.decision_timeline(spark.createDataFrame(moved + first[1:], PAIRS), "2024-02-02", 5)
    assert rows(kept.decision_timeline("2024-02-02", 5)) == rows(whole)


def test_observed_metrics_take_one_scan(spark, tmp_path, sf_dir):
    from partweave.bindings.matching import _facts

    pairs = _facts(spark, sf_dir)
    pairs.write.parquet(f"{tmp_path}/in")
    stored = spark.read.parquet(f"{tmp_path}/in")
    metrics = statistics_metrics(D.MATCH_TYPE_ORDER, [f"RULE_{i}" for i in range(3)])
    seen = write_observed(stored, f"{tmp_path}/out", metrics)
    assert rows(statistics_rows(spark, seen)) == rows(selection.run_statistics(stored))
    assert rows(spark.read.parquet(f"{tmp_path}/out").select("pair_key", "status")) == rows(stored.select("pair_key", "status"))
    with pytest.raises(ValueError):
        statistics_rows(spark, write_observed(stored, f"{tmp_path}/other", statistics_metrics(["IDENTICAL"], [])))


def test_observed_stage_measures(spark, tmp_path):
    norm = spark.createDataFrame([(["x"], ["UOM_MISSING"], ["k"], {"a": 1, "b": 2}), ([], [], [], {}), (["x", "y"], ["OTHER"], ["k"], {"a": 1})],
                                 "expansions array<string>, flags array<string>, missing_required array<string>, attributes map<string,int>")
    seen = write_observed(norm, f"{tmp_path}/norm", stage_measures())
    assert seen == D.stage_metrics(norm).first().asDict()


def test_fanout_writes_the_same_documents_in_one_job(spark, tmp_path):
    canonical = spark.createDataFrame(
        [(f"C{i}", f"NMC-{i:06d}", f"PUMP {i}", "PUMP", "APPROVED", None, "EA", i) for i in range(30)],
        "cnmc string, short_code string, description string, category string, status string, unspsc string, base_uom string, version int").withColumns({
            "attributes": F.create_map().cast(MAP_TYPE), "updated_at": F.timestamp_seconds(F.lit(1_700_000_000) + F.col("version") * 86_400)})
    maps = [(f"C{i % 30}", f"O{i % 3}", f"L{i:03d}", "ACTIVE" if i % 5 else "REVERSED") for i in range(140)] + [("C1", None, "L", "ACTIVE")]
    mappings = spark.createDataFrame(maps, "cnmc string, org string, legacy_code string, status string")
    orgs, stamp, since = ["O0", "O1", "O2"], "20240401120000", "2023-11-20"
    export_delta(canonical, mappings, orgs, f"{tmp_path}/loop", stamp, since)
    export_fanout(canonical, mappings, f"{tmp_path}/once", stamp, since, per_file=4)
    read = lambda p: spark.read.schema("cnmc string, document string, org string").json(p)
    plain = lambda p: sorted((r["org"], r["cnmc"], json.dumps(json.loads(r["document"]), sort_keys=True)) for r in read(p).collect())
    assert plain(f"{tmp_path}/loop") == plain(f"{tmp_path}/once") and len(plain(f"{tmp_path}/once")) > 10
    files = read(f"{tmp_path}/once").groupBy(F.input_file_name().alias("f")).count().collect()
    assert max(r["count"] for r in files) <= 12 and len(files) >= 6
    odata = org_documents(canonical, mappings, stamp, fmt="odata", orgs=["O1"])
    assert {r["org"] for r in odata.collect()} == {"O1"} and json.loads(odata.first()["document"])["d"]["ProductOldID"].startswith("L")
    assert org_documents(canonical.limit(0), mappings, stamp).count() == 0


def test_pairs_leave_the_buckets_of_codes_alone_and_alike_records_are_counted_first(spark, tmp_path):
    from partweave.plans.rollup import contributions

    kept = Rollup(spark, f"{tmp_path}/rollup", buckets=4)
    records = spark.range(60).selectExpr(
        "cast(id as string) record_id", "'A' org", "'PUMP' category", "0.5D completeness", "array('UOM_MISSING') flags",
        "cast(array() as array<string>) missing_required", "array(1, 2) expansions", "concat('C', id % 7) cnmc", "2.5D price", "2D qty")
    cells = [p.count() for p in contributions({"records": records}, {})]
    assert cells[1:] == [21, 7, 7] and cells[0] < 30  # three sums, one organisation and one price a code
    assert [p.count() for p in contributions({"records": records}, {"records": records})] == [0, 0, 0, 0]
    kept.add("records", {"records": records})
    before = {n: b["folder"] for n, b in kept.table.state()["buckets"].items()}
    pairs = spark.createDataFrame([("p1", "a", "b", "A", "B", "PUMP", "DUPLICATE", False, "PENDING", None, True)], PAIRS)
    kept.add("pairs", {"pairs": pairs})
    after = {n: b["folder"] for n, b in kept.table.state()["buckets"].items()}
    assert all(after[n] == f for n, f in before.items() if int(n) < 4) and any(int(n) < 4 for n in before)
    assert kept.table.read().filter("measure = 'code_org'").count() == 7
