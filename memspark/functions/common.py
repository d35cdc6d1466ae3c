"""Small helpers shared by the column functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(key: Column, table: dict, default=None) -> Column:
    """``table[key]`` as a CASE expression, so it stays inside generated code."""
    expr = None
    for k, v in table.items():
        cond, val = key == F.lit(k), F.lit(v)
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr.otherwise(F.lit(default))


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once.

    An expression that a lambda takes from outside is computed again for every element; bound
    as a lambda variable it is not.
    """
    return F.transform(F.array(value), fn)[0]


def fail_when(bad: Column, message: Column | str, value: Column) -> Column:
    """``value``, or a task error carrying ``message`` on the rows where ``bad`` holds."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(bad, F.raise_error(text)).otherwise(value)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def days_between(later: Column, earlier: Column) -> Column:
    """Signed distance in days with microsecond resolution."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6) / F.lit(86400.0)


def blank(x: Column) -> Column:
    """True for NULL and for the empty string."""
    return F.coalesce(x, F.lit("")) == F.lit("")
