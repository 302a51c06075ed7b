"""Two batches of decisions and a batch of reversals against a plain model of groups."""
import pytest
from pyspark.sql import functions as F

from partweave.operators.describe import canonical_description, template_code
from partweave.operators.extract.rules import MAP_TYPE
from partweave.operators.govern import apply_decisions, reverse_mappings
from partweave.session import cut_lineage

from .helpers import records

KIND = ["BRG,DGBB,6205-2RS,C3", "BRG,DGBB,6206-2RS,C3", "BRG,DGBB,6207-ZZ,C3", "BRG,DGBB,6208-2RS,C4"]
# record number -> index of its text; records of one number share a template code
TEXT = [0, 0, 0, 1, 1, 2, 2, 3, 3, 0, 2, 2, 2]
PAIRS = [(0, 1), (1, 2), (0, 2), (3, 4), (2, 3), (2, 9), (5, 6), (10, 11), (7, 8), (6, 10), (4, 9), (0, 7), (11, 12)]
VETOED = {(0, 7)}
name = lambda i: f"rec-{i:04d}"
key = lambda p: f"{name(p[0])}::{name(p[1])}"
DECISION = "pair_key string, action string, note string, decided_at int, edit_description string"
MAPPING = ("record_id string, cnmc string, org string, legacy_code string, match_type string, confidence double, status string, "
           "created_at timestamp, reversed_at timestamp, reversal_reason string")
CANONICAL = (f"cnmc string, short_code string, description string, category string, subtype string, unspsc string, attributes {MAP_TYPE}, "
             "base_uom string, status string, version int, value double, created_at timestamp, updated_at timestamp")


class Model:
    """Groups by union and find; members of a group share a code here, so a new group takes its first member's."""

    def __init__(self, codes):
        self.codes, self.of, self.status, self.proposed = codes, {}, {p: "PENDING" for p in PAIRS}, {}

    def apply(self, decisions):
        approved = [p for p, action in decisions if action in ("APPROVE", "EDIT") and self.status[p] == "PENDING" and p not in VETOED]
        parent = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in approved:
            parent[root(a)] = root(b)
        groups = {}
        for x in list(parent):
            if isinstance(x, int) and x in self.of:
                parent[root(x)] = root(("code", self.of[x]))
        for x in list(parent):
            groups.setdefault(root(x), []).append(x)
        outcomes = {}
        for group in groups.values():
            held = sorted(x[1] for x in group if not isinstance(x, int))
            people = sorted(x for x in group if isinstance(x, int))
            code = held[0] if held else self.codes[people[0]]
            for p in approved:
                if p[0] in people:
                    outcomes[p] = "CONFLICT" if len(held) > 1 else code
            if len(held) < 2:
                self.of.update({x: code for x in people if x not in self.of})
        for p, action in decisions:
            if outcomes.get(p, "CONFLICT") != "CONFLICT":
                self.status[p] = "APPROVED"
            elif action == "REJECT":
                self.status[p] = "REJECTED"
        for p in PAIRS:
            a, b = self.of.get(p[0]), self.of.get(p[1])
            if self.status[p] == "PENDING" and a and a == b:
                self.status[p] = "SUPERSEDED"
            elif self.status[p] == "PENDING" and (a or b):
                self.proposed[p] = a or b
        return outcomes


def test_batches_of_decisions(spark):
    recs = cut_lineage(records(spark, [(KIND[t], {"price": 10.0 + i}) for i, t in enumerate(TEXT)]).withColumn("qty", F.lit(2.0)))
    facts = {r["record_id"]: r for r in recs.select("record_id", template_code(F.col("category"), F.col("attributes")).alias("code"),
                                                    canonical_description(F.col("category"), F.col("attributes")).alias("title")).collect()}
    codes = [facts[name(i)]["code"] for i in range(len(TEXT))]
    assert len(set(codes)) == len(KIND)
    model = Model(codes)
    recommendations = spark.createDataFrame(
        [(key(p), name(p[0]), name(p[1]), "BEARING", "DUPLICATE", 0.9, p in VETOED, "PENDING", None, None, None) for p in PAIRS],
        "pair_key string, a_record_id string, b_record_id string, category string, match_type string, final_score double, vetoed boolean, "
        "status string, proposed_cnmc string, proposed_description string, decision_note string")
    mappings, canonical = spark.createDataFrame([], MAPPING), spark.createDataFrame([], CANONICAL)
    batches = [[((0, 1), "APPROVE"), ((1, 2), "APPROVE"), ((3, 4), "APPROVE"), ((5, 6), "APPROVE"), ((10, 11), "APPROVE"), ((7, 8), "EDIT"),
                ((0, 7), "APPROVE")],
               [((2, 9), "APPROVE"), ((2, 3), "APPROVE"), ((4, 9), "REJECT"), ((0, 1), "APPROVE"), ((11, 12), "APPROVE")]]
    for n, batch in enumerate(batches):
        rows = [(key(p), a, "a good reason", i, "STEWARD TITLE" if a == "EDIT" else None) for i, (p, a) in enumerate(batch)]
        decisions = spark.createDataFrame(rows[::-1], DECISION).withColumn("edit_attributes", F.lit(None).cast(MAP_TYPE))
        done = apply_decisions(decisions, recommendations, recs, mappings, canonical, f"2024-01-0{n + 1}")
        before = dict(model.of)
        expected = model.apply(batch)
        out = {r["pair_key"]: r for r in done.outcomes.collect()}
        for p, a in batch:
            r = out[key(p)]
            if expected.get(p, "CONFLICT") != "CONFLICT":
                assert (r["outcome"], r["cnmc"], r["error"]) == ("APPROVED", expected[p], None), r
            elif a != "REJECT":
                assert r["outcome"] is None and r["cnmc"] is None and r["error"], r
        mappings, canonical, recommendations = done.mappings, done.canonical, done.recommendations
        held = mappings.collect()
        assert {r["record_id"]: r["cnmc"] for r in held} == {name(i): c for i, c in model.of.items()} and len(held) == len(model.of)
        assert all(r["created_at"].day == (1 if int(r["record_id"][4:]) in before else n + 1) for r in held)
        status = {r["pair_key"]: r for r in recommendations.collect()}
        assert {p: status[key(p)]["status"] for p in PAIRS} == model.status
        for p, c in model.proposed.items():
            assert status[key(p)]["proposed_cnmc"] == c
        material = {r["cnmc"]: r for r in canonical.collect()}
        assert set(material) == set(model.of.values())
        for c, r in material.items():
            assert r["value"] == pytest.approx(sum(2 * (10.0 + i) for i, x in model.of.items() if x == c)) and r["version"] == 1
            first = min(i for i, x in model.of.items() if x == c)
            assert r["description"] == ("STEWARD TITLE" if first == 7 else facts[name(first)]["title"])
        assert len({r["short_code"] for r in material.values()}) == len(material)
    assert model.status[(0, 2)] == "SUPERSEDED" and model.status[(2, 3)] == "PENDING" and "transitively" in status[key((0, 2))]["decision_note"]
    # One conflict holds back every approval of its component.
    assert 9 not in model.of and model.of[12] == model.of[5]
    assert all("different canonical" in out[key(p)]["error"] for p in [(2, 3), (2, 9)]) and "already" in out[key((0, 1))]["error"]

    a, b = model.of[0], model.of[3]
    requests = spark.createDataFrame([(name(3), b, "wrong maker"), (name(4), b, "wrong maker"), (name(0), a, "wrong maker"), (name(1), a, "no"),
                                      (name(1), b, "not there")], "record_id string, cnmc string, reason string")
    outcomes, after, canon = reverse_mappings(requests, mappings, canonical, recs, "2024-02-01")
    errors = {(r["record_id"], r["cnmc"]): r["error"] for r in outcomes.collect()}
    assert errors == {(name(3), b): None, (name(4), b): None, (name(0), a): None, (name(1), a): "A reversal reason is required",
                      (name(1), b): "Mapping not found"}
    rows = after.collect()
    assert len(rows) == len(model.of) and {r["record_id"] for r in rows if r["status"] == "REVERSED"} == {name(i) for i in (0, 3, 4)}
    state = {r["cnmc"]: r for r in canon.collect()}
    assert state[b]["status"] == "RETIRED" and state[a]["status"] == "APPROVED"
    assert state[a]["value"] == pytest.approx(sum(2 * (10.0 + i) for i in (1, 2)))
    again = reverse_mappings(requests.filter(F.col("record_id") == name(3)), cut_lineage(after), cut_lineage(canon), recs, "2024-02-02")
    assert [r["error"] for r in again[0].collect()] == ["Mapping is already reversed"]
