"""Names for values inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parsed(text: Column) -> Column:
    """A JSON object's entries side by side: ``texts``, as written, and ``values``, as variants that know their types."""
    return F.struct(F.from_json(text, "map<string,string>").alias("texts"), F.from_json(text, "map<string,variant>").alias("values"))
