"""Carrying rows through an operator without touching their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def column(name: str) -> Column:
    """A column of any name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """All columns of each row as one struct ``row``, next to columns of the operator's own."""
    return docs.select(F.struct(*map(column, docs.columns)).alias("row"), *(c.alias(n) for n, c in columns.items()))


def unpacked(df: DataFrame, **others: Column) -> DataFrame:
    """The columns that ``packed`` took, and of the operator's own only ``others``."""
    return df.select(*(F.col("row").getField(n).alias(n) for n in df.schema["row"].dataType.names), *(c.alias(n) for n, c in others.items()))


def fresh(name: str, columns: list[str]) -> str:
    """``name``, or the first longer one that no column has (case aside, as Spark compares)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def schema_with(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of ``df`` with the columns of ``ddl`` behind it."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])
