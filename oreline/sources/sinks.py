"""Sinks: sorted Parquet, immutable artifacts, append-only tables, exports."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreline.operators.aggregates import content_digest


def write_partition(df: DataFrame, path: str, order: list[str], *, by: list[str] | None = None, files: int | None = None) -> None:
    """zstd Parquet, range-partitioned and sorted, so that row groups prune by ``order``."""
    ranged = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    writer = ranged.sortWithinPartitions(*order).write.mode("errorifexists").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def publish(df: DataFrame, root: str, columns: list[str]) -> str:
    """Write a frame under its logical digest; the same content is written once.

    The digest does not depend on row order or file layout.
    """
    digest = content_digest(df, columns).first()["digest"]
    path = f"{root.rstrip('/')}/sha256={digest}"
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def replayed_equal(first: DataFrame, second: DataFrame, columns: list[str]) -> bool:
    """Whether two builds have the same logical content."""
    return content_digest(first, columns).first() == content_digest(second, columns).first()


def append_rows(df: DataFrame, path: str, schema_columns: list[str], *, by: list[str] | None = None) -> None:
    """Append to a table; unknown or missing columns are refused."""
    if set(df.columns) != set(schema_columns):
        raise ValueError(f"columns differ: {sorted(set(df.columns) ^ set(schema_columns))}")
    writer = df.select(*schema_columns).write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def rebuild(df: DataFrame, path: str) -> None:
    """Replace a mart as a whole."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


@dataclass(frozen=True)
class Profile:
    """How one jurisdiction's rows become mart rows: which rows, and an expression per mart column."""

    name: str
    where: str
    columns: dict[str, str]


def projected(df: DataFrame, profiles: list[Profile]) -> DataFrame:
    """The mart rows of all profiles in one frame; profiles must name the same columns."""
    columns = list(profiles[0].columns)
    if any(list(p.columns) != columns for p in profiles):
        raise ValueError("profiles differ in their columns")
    arms = [df.where(p.where).select(F.lit(p.name).alias("profile"), *(F.expr(p.columns[c]).alias(c) for c in columns)) for p in profiles]
    return reduce(DataFrame.unionByName, arms)


def rebuild_profiles(df: DataFrame, profiles: list[Profile], path: str) -> DataFrame:
    """Replace the partitions of these profiles, and no others; returns the mart.

    Every row carries the digest of its profile's content, so equal builds are
    told from changed ones; a profile without rows keeps its old partition.
    """
    rows = projected(df, profiles)
    measured = [c for c in rows.columns if c != "profile"]
    hashed = F.xxhash64(*measured).cast("decimal(38,0)")
    digests = rows.groupBy("profile").agg(F.sha2(F.concat_ws(":", F.count("*"), F.sum(hashed)), 256).alias("derivation"))
    out = rows.join(digests, "profile")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("profile").parquet(path)
    return df.sparkSession.read.parquet(path)


def coverage_document(df: DataFrame) -> DataFrame:
    """One-row aggregates as one JSON text with fields in name order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("document"))


def export_csv(df: DataFrame, path: str, provenance: dict[str, str]) -> None:
    """CSV with its provenance as columns, so that every file carries it."""
    df.withColumns({k: F.lit(v) for k, v in sorted(provenance.items())}).write.mode("overwrite").option("header", True).csv(path)


def named_views(spark: SparkSession, uris: dict[str, str]) -> None:
    for name, uri in uris.items():
        spark.read.parquet(uri).createOrReplaceTempView(name)
