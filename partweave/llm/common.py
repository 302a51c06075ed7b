"""Helpers shared by the corpus operators."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: White space of the word contract, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: inside a lambda an outer expression would run per element."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back: cuts the lineage, so a lost
    executor never replays what lies before, and gives the optimiser a column-pruned source with known size.

    The shuffle files behind it are of no more use; Spark deletes them once the driver's heap has dropped their
    owners, so one collection is asked for: disk then holds the largest step instead of all of them."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def boxed(rows: DataFrame) -> DataFrame:
    """``rows`` as one column ``row``: whatever is joined to it clashes with none of their names."""
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))


def cell(name: str) -> Column:
    return F.col(f"row.`{name}`")


def unboxed(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The ``columns`` of the boxed rows, those in ``changed`` with a new value; further ones in ``changed`` follow."""
    given = {name.lower(): value for name, value in changed.items()}
    kept = [given.pop(c.lower(), cell(c)).alias(c) for c in columns]
    return rows.select(*kept, *[value.alias(name) for name, value in changed.items() if name.lower() in given])


def documents_of(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
