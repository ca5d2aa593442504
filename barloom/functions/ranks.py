"""Fixed-shape helpers used by several operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def count_if(cond: Column) -> Column:
    """Conditional count that is 0, not null, on an empty group."""
    return F.count(F.when(cond, F.lit(1)))
