"""Small helpers shared by the registered driver queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column | str, name: str | None = None) -> Column:
    """Doubles are compared rounded to 6 places in both engines."""
    col = F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6)
    return col.alias(name or (c if isinstance(c, str) else "value"))


def big(c: Column | str, name: str | None = None) -> Column:
    col = (F.col(c) if isinstance(c, str) else c).cast("bigint")
    return col.alias(name or (c if isinstance(c, str) else "value"))
