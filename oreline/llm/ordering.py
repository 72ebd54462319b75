"""Places of rows in a total order, without meeting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oreline.storage import Passes


def numbered(rows: DataFrame, order: list[str], passes: Passes, name: str, place: str = "at") -> DataFrame:
    """``rows`` with their place (from 0) in the order of the columns ``order``.

    Rows are dealt by range and sorted there; a range's first place is the
    number of rows in the ranges before it, from a table of one row a range,
    which is therefore broadcast. The sorted rows are written, so that places
    stay what they are when an executor is lost. Rows that agree in all order
    columns sit in one range: name enough columns that none is large.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = passes.write(dealt.withColumn("__seq", F.monotonically_increasing_id()), name)
    part = F.shiftright("__seq", 33)
    ranges = ordered.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"), F.min("__seq").alias("__low"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = ranges.select("__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__low")).alias("__shift"))
    found = ordered.withColumn("__part", part).join(F.broadcast(first), "__part")
    return found.select(*rows.columns, (F.col("__seq") + F.col("__shift")).alias(place))
