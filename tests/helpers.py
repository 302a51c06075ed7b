"""Builds records the way the engine does."""
from pyspark.sql import functions as F

from partweave.operators.embed import with_embedding
from partweave.operators.process import process_records

SCHEMA = ("record_id string, org string, legacy_code string, description string, long_text string, uom string, "
          "manufacturer string, part_number string, price double")


def records(spark, specs):
    """specs: list of (description, {org, uom, manufacturer, part_number, price})."""
    rows = []
    for i, spec in enumerate(specs):
        text, opts = spec if isinstance(spec, tuple) else (spec, {})
        rows.append((f"rec-{i:04d}", opts.get("org", "CPCL"), f"T{i}", text, opts.get("long_text"),
                     opts.get("uom", "EA"), opts.get("manufacturer"), opts.get("part_number"), opts.get("price")))
    return with_embedding(process_records(spark.createDataFrame(rows, SCHEMA).repartition(2)))


def values(attributes):
    return {k: (v["value_num"] if v["value_num"] is not None else v["value_text"]) for k, v in attributes.items()}
