"""Keyset pagination: a page is a filter, an order and a limit, never an offset."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def query_fingerprint(params: dict) -> str:
    return hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]


def encode_cursor(last: list, as_of: str, params: dict) -> str:
    body = {"k": last, "a": as_of, "f": query_fingerprint(params)}
    return base64.urlsafe_b64encode(json.dumps(body, default=str).encode()).decode()


def decode_cursor(cursor: str, params: dict) -> tuple[list, str]:
    """Key and as-of of a cursor; one made for another query is refused."""
    try:
        body = json.loads(base64.urlsafe_b64decode(cursor.encode()))
        key, as_of, mark = body["k"], body["a"], body["f"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("cursor can't be read") from e
    if mark != query_fingerprint(params):
        raise ValueError("cursor belongs to another query")
    return key, as_of


def after(keys: list[str], last: list | None):
    """Row-value comparison ``(k1, k2, ...) > last``, expanded so that it is pushed down."""
    if last is None:
        return F.lit(True)
    test, equal = F.lit(False), F.lit(True)
    for k, v in zip(keys, last):
        test = test | (equal & (F.col(k) > F.lit(v)))
        equal = equal & (F.col(k) == F.lit(v))
    return test


def page(df: DataFrame, keys: list[str], size: int, last: list | None = None) -> DataFrame:
    """A page and one row more, which proves that another page follows."""
    return df.where(after(keys, last)).orderBy(*keys).limit(size + 1)


def top_n(df: DataFrame, by: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(by), F.asc(tie)).limit(n)
