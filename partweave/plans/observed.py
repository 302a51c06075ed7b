"""Metrics of a run taken while its result is written (R10, Q14), instead of by reading it again.

``DataFrame.observe`` computes the aggregates on the rows that pass to the writer.  The observation stands directly before
the write, so each partition counts once, also when a task is tried again."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_observed(rows: DataFrame, path: str, metrics: dict[str, Column], mode: str = "errorifexists") -> dict:
    """Write ``rows`` as Parquet and return the metrics of what was written; one scan of the input."""
    seen = Observation()
    rows.observe(seen, *[c.alias(n) for n, c in metrics.items()]).write.mode(mode).parquet(path)
    return seen.get


def statistics_metrics(match_types: list[str], rules: list[str]) -> dict[str, Column]:
    """One count for each match type and veto rule (fixed lists of the masters), and the pairs that fit none of them."""
    by_type = {f"match_type\x1f{m}": F.count_if(F.col("match_type") == m) for m in match_types}
    hits = lambda rule: F.coalesce(F.sum(F.size(F.filter("vetoes", lambda v: v["rule"] == rule))), F.lit(0))
    by_rule = {f"veto\x1f{r}": hits(r) for r in rules}
    unknown = F.count_if(~F.coalesce(F.col("match_type").isin(match_types), F.lit(False)) | F.exists(
        "vetoes", lambda v: ~F.coalesce(v["rule"].isin(rules), F.lit(False))))
    return by_type | by_rule | {"unknown": unknown}


def statistics_rows(spark: SparkSession, seen: dict) -> DataFrame:
    """(kind, key, n) as ``selection.run_statistics`` gives it; refuses counts that would leave pairs out."""
    if seen["unknown"]:
        raise ValueError(f"{seen['unknown']} pairs have a match type or veto rule that is not listed")
    rows = [(*name.split("\x1f"), int(n)) for name, n in seen.items() if name != "unknown" and n]
    return spark.createDataFrame(rows, "kind string, key string, n long")


def stage_measures() -> dict[str, Column]:
    """What the normalise and classify stages report; the measures of ``dashboard.stage_metrics``."""
    return {
        "normalized": F.count(F.lit(1)), "abbreviations": F.coalesce(F.sum(F.size("expansions")), F.lit(0)),
        "uom_issues": F.count_if(F.exists("flags", lambda f: f.startswith("UOM_"))),
        "insufficient": F.count_if(F.size("missing_required") > 0),
        "attributes": F.coalesce(F.sum(F.size(F.map_keys("attributes"))), F.lit(0))}
