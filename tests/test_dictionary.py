"""The dictionary as a joined table against the compiled one, and replays of old batches."""
import random

from pyspark.sql import functions as F

from partweave import masters
from partweave.functions.text import expand_text
from partweave.operators.dictionary import expand_as_of, validity

HISTORY = "term string, category string, kind string, expansion string, version int, changed_at int"


def test_equals_the_compiled_dictionary(spark):
    draw = random.Random(5)
    terms = [d.term.upper() for d in masters.DICTIONARY]
    families = [None, "VALVE", "BEARING", "CABLE", "NO SUCH"]
    glue = [" ", " ", " ", "-", "/", ".", '"', "", "  ", "#", "é"]
    texts = ["".join(draw.choice(terms + ["BRGX", "2", "1/2", "PUMP"]) + draw.choice(glue) for _ in range(draw.randrange(12))) for _ in range(300)]
    texts += ["", None, " ", '"', "BRG", "BRG BRG", terms[0] * 2]
    rows = spark.createDataFrame([(i, t, families[i % 5], 7) for i, t in enumerate(texts)],
                                 "record_id int, cleaned string, category string, ingested_at int").repartition(4)
    history = spark.createDataFrame([(d.term, d.category, d.kind, d.expansion, 1, 1) for d in masters.DICTIONARY], HISTORY)
    got = {r["record_id"]: (r["expanded"], r["expansions"]) for r in expand_as_of(rows, history).collect()}
    assert len(got) == len(texts)
    for family in families:
        some = rows.filter(F.col("category").eqNullSafe(F.lit(family))).withColumn("e", expand_text(
            F.coalesce("cleaned", F.lit("")), masters.DICTIONARY, family))
        for r in some.collect():
            assert got[r["record_id"]] == (r["e"]["text"], r["e"]["expansions"]), r


def test_an_old_batch_keeps_its_text(spark):
    history = spark.createDataFrame([
        ("vlv", None, "ABBREVIATION", "VALVE", 1, 10), ("VLV", None, "ABBREVIATION", "STOP VALVE", 2, 20), ("VLV", None, "ABBREVIATION", None, 3, 30),
        ("GT", "VALVE", "ABBREVIATION", "GATE", 1, 10), ("GT", None, "ABBREVIATION", "GREAT", 1, 10), ("STOP VALVE", None, "SYNONYM", "ISOLATOR", 1, 25),
        ("X", None, "SYNONYM", "EARLY", 1, 10), ("X", None, "SYNONYM", "LATE", 2, 10)], HISTORY)
    spans = {(r["term"], r["expansion"], r["valid_from"], r["valid_to"]) for r in validity(history.filter("kind = 'SYNONYM' or term <> 'GT'")).collect()}
    assert spans == {("VLV", "VALVE", 10, 20), ("VLV", "STOP VALVE", 20, 30), ("STOP VALVE", "ISOLATOR", 25, None), ("X", "LATE", 10, None)}
    rows = [(9, 9, "VALVE"), (10, 10, "VALVE"), (19, 19, "PUMP"), (20, 20, "VALVE"), (25, 25, "VALVE"), (30, 30, "VALVE"), (99, None, "VALVE")]
    records = spark.createDataFrame(rows, "record_id int, ingested_at int, category string").withColumn("cleaned", F.lit("VLV GT X"))
    replay = lambda h: {r["record_id"]: r["expanded"] for r in expand_as_of(records, h).collect()}
    assert replay(history) == {9: "VLV GT X", 10: "VALVE GATE LATE", 19: "VALVE GREAT LATE", 20: "STOP VALVE GATE LATE",
                               25: "ISOLATOR GATE LATE", 30: "VLV GATE LATE", 99: "VLV GT X"}
    later = history.unionAll(spark.createDataFrame([("VLV", None, "ABBREVIATION", "TAP", 4, 40), ("GT", "VALVE", "ABBREVIATION", "GLOBE", 2, 35)], HISTORY))
    assert replay(later) == replay(history)
