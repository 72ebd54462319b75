"""Held-out rule and bounded training samples, shared by the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreline.storage import written

FOLDS = 5


def fold_of(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo five; fold 0 is never learned from."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")) % FOLDS, F.lit(0).cast("long"))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, bound: int, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text, label`` of at most ``bound`` labelled documents outside fold 0.

    The sample is the ``bound`` smallest hashes of the ids, so reruns agree and
    it spreads over the table; its ids (at most ``bound`` rows) are broadcast
    and the texts are never shuffled. A document labelled twice takes its
    largest label; rows without an id or a label are left out.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & (fold_of(doc_id) != 0))
    chosen = known.groupBy(F.col(doc_id).cast("long").alias("id")).agg(F.max(label).cast("int").alias("label"))
    chosen = written(chosen.orderBy(F.xxhash64("id"), "id").limit(bound), "training-ids")
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").withColumnRenamed("id", "doc_id")
