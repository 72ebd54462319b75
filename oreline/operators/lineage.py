"""Derivation graph: content ids, capture, bounded walks, manifests, rendering."""

from __future__ import annotations

import base64
import hashlib
import json
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oreline.operators.append import refuse_any
from oreline.operators.windows import joined_back
from oreline.storage import Passes, written


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def content_id(prefix: str, value: object) -> str:
    """Short id of any JSON value: 12 bytes of its SHA-256 in base 32."""
    digest = hashlib.sha256(canonical_json(value).encode()).digest()[:12]
    return f"{prefix}_{base64.b32encode(digest).decode().rstrip('=').lower()}"


@dataclass
class Derivation:
    operation: str
    inputs: list[tuple[str, str, str]] = field(default_factory=list)  # kind, ref, role
    params: dict = field(default_factory=dict)
    rules: list[str] = field(default_factory=list)
    output: str = ""
    status: str = "open"

    @property
    def derivation_id(self) -> str:
        return content_id("drv", [self.operation, sorted(self.inputs), self.params, sorted(self.rules), self.output])


_OPEN: list[Derivation] = []


@contextmanager
def derive(log: list[Derivation], operation: str, output: str, **params):
    """Record an operation; nested ones become inputs, failures are recorded too."""
    d = Derivation(operation, params=params, output=output)
    _OPEN.append(d)
    try:
        yield d
        d.status = "complete"
    except BaseException:
        d.status = "failed"
        raise
    finally:
        _OPEN.pop()
        same = [x for x in log if x.derivation_id == d.derivation_id and x.status != d.status]
        if same and d.status == "complete" and any(x.status == "complete" for x in same):
            raise ValueError(f"{d.derivation_id} was recorded with another outcome")
        log.append(d)
        if _OPEN and d.status == "complete":
            _OPEN[-1].inputs.append(("derivation", d.derivation_id, "nested"))


def lineage_frames(spark: SparkSession, log: list[Derivation]) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of captured derivations."""
    nodes = [(d.derivation_id, d.operation, d.output, canonical_json(d.params), d.status) for d in log]
    edges = [(d.derivation_id, i, kind, ref, role) for d in log for i, (kind, ref, role) in enumerate(d.inputs)]
    return (
        spark.createDataFrame(nodes, "derivation_id string, operation string, output_dataset string, params string, status string"),
        spark.createDataFrame(edges, "derivation_id string, ord int, kind string, ref_id string, role string"),
    )


def walk(edges: DataFrame, root: DataFrame, src: str, dst: str, *, depth: int = 8) -> DataFrame:
    """Nodes within ``depth`` steps of each root, each at its least depth.

    ``root`` has one column, the start node. Each step is one join with the edge
    table; its nodes are distinct and written once, so that cycles stay small and
    later steps don't repeat earlier ones.
    """
    start = root.columns[0]
    links = edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).distinct()
    levels = [root.select(F.col(start).alias("root"), F.col(start).alias("node")).distinct()]
    for _ in range(depth):
        reached = written(levels[-1].join(links, "node").select("root", F.col("next").alias("node")).distinct(), "walk")
        levels.append(reached)
        if reached.isEmpty():
            break
    marked = [level.withColumn("depth", F.lit(d)) for d, level in enumerate(levels)]
    return reduce(DataFrame.union, marked).groupBy("root", "node").agg(F.min("depth").alias("depth"))


def truncated(edges: DataFrame, walked: DataFrame, src: str, depth: int) -> DataFrame:
    """Roots whose walk ended at the depth bound with edges left."""
    return walked.where(F.col("depth") == depth).join(edges.select(F.col(src).alias("node")), "node", "left_semi").select("root").distinct()


def to_dot(edges: list[tuple[str, str]]) -> str:
    lines = [f'  "{a}" -> "{b}";' for a, b in sorted(set(edges))]
    return "\n".join(["digraph lineage {", *lines, "}"])


def manifest_heads(manifests: DataFrame) -> DataFrame:
    """Newest manifest of each (source_id, source_key)."""
    w = Window.partitionBy("source_id", "source_key").orderBy(F.desc("fetch_vintage"), F.desc("manifest_id"))
    return manifests.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def register_manifests(existing: DataFrame, fetched: DataFrame) -> DataFrame:
    """Fetched artifacts to append: equal bytes register nothing, changed bytes supersede the head.

    Rows have ``manifest_id, source_id, source_key, sha256, fetch_vintage``.
    """
    seen = existing.select("source_id", "source_key", "sha256")
    new = fetched.join(seen, ["source_id", "source_key", "sha256"], "left_anti")
    heads = manifest_heads(existing).select("source_id", "source_key", F.col("manifest_id").alias("supersedes_manifest_id"))
    return new.join(heads, ["source_id", "source_key"], "left")


def _doubled(now: DataFrame) -> DataFrame:
    """``node, ahead, head, place`` with pointers twice as long; rows that point nowhere are not joined.

    They grow with every round and have one key, null, which a join would put
    into one task. Both sides keep the session's number of partitions: keys
    compress so well that merged by bytes they would be far too many for a task.
    """
    parts = int(now.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    jump = now.select(F.col("node").alias("ahead"), F.col("ahead").alias("__ahead"), F.col("head").alias("__head"), F.col("place").alias("__place")).repartition(parts, "ahead")
    met = now.where("ahead IS NOT NULL").repartition(parts, "ahead").join(jump, "ahead", "left")
    moved = met.select("node", F.col("__ahead").alias("ahead"), F.coalesce("__head", "head").alias("head"), (F.col("place") + F.coalesce("__place", F.lit(0))).alias("place"))
    return moved.union(now.where("ahead IS NULL").select("node", "ahead", "head", "place"))


def supersession_chain(manifests: DataFrame, *, key: str = "manifest_id", supersedes: str = "supersedes_manifest_id") -> DataFrame:
    """``key, head, place``: each manifest's newest successor and its place behind it, 0 for the newest.

    Pointers are doubled: after r rounds every manifest knows who stands 2^r
    places ahead, so a chain of n takes log n rounds, each one join and one
    written table. A manifest that two others supersede is refused, and so is a
    cycle. Pointers to manifests that are not in the table end the chain.
    """
    spark = manifests.sparkSession
    rounds = Passes(spark, "supersession")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rounds.write(manifests.select(F.col(key).alias("node"), F.col(supersedes).alias("older")), "rows")
    ahead = rows.where("older IS NOT NULL").select(F.col("older").alias("node"), F.col("node").alias("ahead")).repartition(parts, "node")
    refuse_any(ahead.groupBy("node").agg(F.count_distinct("ahead").alias("n")).where("n > 1"), "superseded twice")
    nodes = rows.select("node").repartition(parts, "node").distinct()
    first = nodes.join(ahead.distinct(), "node", "left").withColumn("place", F.col("ahead").isNotNull().cast("long"))
    now = rounds.write(first.select("node", "ahead", F.coalesce("ahead", "node").alias("head"), "place"), "round-0")
    rounds.drop("rows")
    longest, number = now.count(), 0
    while now.where("ahead IS NOT NULL").limit(1).count():
        if 1 << number > longest:
            raise ValueError("manifests supersede each other in a cycle")
        number += 1
        now = rounds.write(_doubled(now), f"round-{number}")
        rounds.drop(f"round-{number - 1}")
    return now.select(F.col("node").alias(key), "head", "place")


def selector_matches(selectors: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``selectors`` with ``n``, the stored rows that each names, ``exactly_one`` and ``any_row``.

    The many-selector form of ``one_row_selector``: rows are counted per key
    before they meet the selectors; null parts name null parts.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return joined_back(selectors, counts, keys).withColumns({"exactly_one": n == 1, "any_row": n > 0, "n": n})


def one_row_selector(df: DataFrame, selector: dict, *, exact: bool = True) -> bool:
    """Whether a selector names exactly one (or any) stored row; reads two rows at most."""
    for k, v in selector.items():
        df = df.where(F.col(k) == F.lit(v))
    n = df.limit(2).count()
    return n == 1 if exact else n >= 1
