"""Values that higher-order functions read many times but compute once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once for a row, however often its lambdas read it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
