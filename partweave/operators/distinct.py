"""Costly columns once for each combination of the values they are made of, not once a row.

Material texts repeat: the same description stands in many records, of many organisations.  The distinct values are dealt
over ``spark.sql.shuffle.partitions`` tasks by their hash - a number that adaptive execution keeps, because a few MB of
texts may be hours of rules -, computed, written to the checkpoint folder, and joined to the rows again.  If all values
differ, the work is that of a projection, plus one shuffle of the rows.  A value that very many rows hold is one row on the
computed side; adaptive execution splits the rows' side of the join.

Null is a value like any other; the rows keep their number and their other columns."""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def computed_once(rows: DataFrame, values: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(values..., columns that ``compute`` adds) for the distinct ``values`` of ``rows``; ``compute`` keeps its rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(compute(rows.select(*values).distinct().repartition(parts, *values)))


def with_computed(rows: DataFrame, values: list[str], computed: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``computed_once``; ``values`` are names or columns of ``rows`` in its order.  A column of
    ``rows`` that has the name of a computed one is replaced."""
    keys, added = computed.columns[:len(values)], computed.columns[len(values):]
    marked = rows.select("*", *[(F.col(v) if isinstance(v, str) else v).alias(f"_value_{i}") for i, v in enumerate(values)])
    found = computed.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], *[
        F.col(c).alias(f"_new_{i}") for i, c in enumerate(added)])
    met = reduce(lambda a, b: a & b, [F.col(f"_value_{i}").eqNullSafe(F.col(f"_key_{i}")) for i in range(len(keys))])
    return marked.join(found, met).select(*[c for c in rows.columns if c not in added], *[
        F.col(f"_new_{i}").alias(c) for i, c in enumerate(added)])
