"""Read API shapes: well lists, scope sets, glossary index, series projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreline.functions.scalar import contains_text


def filtered(df: DataFrame, predicates: list[Column | None], exists: list[tuple[DataFrame, list[str]]] | None = None) -> DataFrame:
    """Optional filters of a list request; EXISTS tests become semi joins."""
    out = reduce(lambda d, p: d if p is None else d.where(p), predicates, df)
    return reduce(lambda d, e: d.join(e[0].select(*e[1]), e[1], "left_semi"), exists or [], out)


def scope_set(terms: list[str], registered: set[str]) -> list[str] | None:
    """Scope terms, comma-joined or repeated, as a sorted set; ``None`` means all."""
    flat = sorted({t.strip().upper() for term in terms for t in term.split(",") if t.strip()})
    if "ALL" in flat:
        if len(flat) > 1:
            raise ValueError("'all' can't be mixed with other terms")
        return None
    unknown = set(flat) - registered
    if unknown:
        raise ValueError(f"not registered: {sorted(unknown)}")
    return flat


def resolved(df: DataFrame, resolver: DataFrame, keys: list[str], promoted: str, absence: str) -> DataFrame:
    """Read-time status: the promoted one, else the registry's, else the absence class."""
    table = resolver.select(*keys, F.col("status").alias("__status"))
    return df.join(table, keys, "left").withColumn("resolved_status", F.coalesce(promoted, "__status", F.lit(absence))).drop("__status")


def glossary_index(terms: DataFrame, name: str, aliases: str) -> DataFrame:
    """Surface forms, longest first, for longest-match highlighting."""
    forms = terms.select(name, F.explode(F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>")))).alias("form"))
    return forms.withColumn("words", F.size(F.split("form", " "))).distinct()


def glossary_search(terms: DataFrame, name: str, body: str, needle: str) -> DataFrame:
    return terms.where(contains_text(name, needle) | contains_text(body, needle))


def per_thousand(volume: Column, length: Column, floor: float) -> Column:
    """Volume per thousand of length; none below the floor."""
    return F.when(length >= floor, volume / (length / 1000))


def point_fact(has_value: Column, fact: Column, pending: Column, lease: Column) -> Column:
    """What a plotted month states."""
    return F.when(pending, "multi_pool_pending").when(lease, "lease_reported").when(has_value, fact).otherwise(F.coalesce(fact, F.lit("no_report")))


def status_precedence(code: Column, plug_date: Column, token: str) -> Column:
    """A plug date stands before the filed code; blank codes stay absent."""
    return F.when(F.length(F.trim(plug_date)) > 0, F.lit(token)).otherwise(F.nullif(F.trim(code), F.lit("")))


def basin_membership(inside: Column, has_geometry: Column, label: Column, name: Column) -> tuple[Column, Column]:
    place = F.when(~has_geometry, "no_geometry").when(inside, "in_published_boundary").otherwise("outside")
    agree = F.lower(F.trim(label)) == F.lower(F.trim(name))
    match = F.when(label.isNull(), "no_label").when(name.isNull(), "not_labelled").when(agree, "agree").otherwise("disagree")
    return place, match
