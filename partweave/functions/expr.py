"""Small Column combinators shared by every operator."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body`` (keeps nested expressions from multiplying)."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return F.when(F.length(F.trim(c)) > 0, c)


def half_up(c: Column, dp: int = 3) -> Column:
    """floor(x * 10^dp + 0.5) / 10^dp."""
    k = float(10 ** dp)
    return F.floor(c * k + 0.5).cast("double") / k


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def num_to_text(c: Column) -> Column:
    """Text of a number the way identity keys need it: 2.0 -> '2', 1.10 -> '1.1', no exponent."""
    x = c.cast("double")
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    plain = F.regexp_replace(x.cast("decimal(38,12)").cast("string"), r"\.?0+$", "")
    return (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when(whole, F.floor(x).cast("string"))
        .when((F.abs(x) >= 1e7) | (F.abs(x) < 1e-3), plain)
        .otherwise(x.cast("string"))
    )


def code_number(c: Column) -> Column:
    """Number for a code segment: integers without a fraction, otherwise at most two decimals."""
    return num_to_text(half_up(c.cast("double"), 2))


def _sql_literal(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, float):
        return f"{v!r}D"
    if isinstance(v, (list, tuple)):
        return "array(" + ",".join(_sql_literal(x) for x in v) + ")"
    return str(v)


def str_array(values) -> Column:
    """Literal array, parsed in one step instead of one driver round trip per element."""
    return F.expr(_sql_literal(list(values)))


def str_map(pairs: dict) -> Column:
    """Literal map; the domain vocabularies are a few dozen entries."""
    return F.expr("map(" + ",".join(f"{_sql_literal(k)},{_sql_literal(v)}" for k, v in pairs.items()) + ")")


_BUILT: dict = {}


def built_once(key, make: Callable[[], Column]) -> Column:
    """Reuse a large expression over named columns; building one costs thousands of driver-to-JVM calls."""
    from pyspark.sql import SparkSession

    session = SparkSession.getActiveSession()
    key = (session.sparkContext.applicationId if session else None, key)
    if key not in _BUILT:
        _BUILT[key] = make()
    return _BUILT[key]


def lookup(pairs: dict, key: Column) -> Column:
    return F.try_element_at(str_map(pairs), key)


def matched(text: Column, pattern: str, group: int = 0) -> Column:
    """Group of the first match or NULL when the pattern does not occur."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def contains_text(c: Column, needle: str | Column) -> Column:
    """Case-insensitive literal contains; LIKE wildcards in the needle have no special meaning."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return F.contains(F.upper(c), F.upper(needle))


def any_column_contains(cols: Sequence[str], needle: str) -> Column:
    return contains_text(F.concat_ws(" ", *[F.col(c).cast("string") for c in cols]), needle)


def compact(*cols: Column) -> Column:
    return F.array_compact(F.array(*cols))
