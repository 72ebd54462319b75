"""Rules are rows: a predicate tree and executors that split kept from rejected.

An executor takes a frame and a rule and returns ``(kept, rejected)``; rejected
rows carry ``reason_code`` and ``rule_id`` and go to the quarantine ledger.
"""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreline.functions.scalar import composite_key, scaled
from oreline.operators import datum

_NAME = re.compile(r"^[a-z_][a-z0-9_]*$")
_COMPARE = {"eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    kind: str
    spec: dict = field(default_factory=dict)
    on_fail: str = "quarantine"

    @classmethod
    def from_json(cls, rule_id: str, kind: str, spec: str, on_fail: str = "quarantine") -> "Rule":
        return cls(rule_id, kind, json.loads(spec), on_fail)


def _leaf(node: dict) -> Column:
    if set(node) == {"col"} and isinstance(node["col"], str) and _NAME.match(node["col"]):
        return F.col(node["col"])
    if set(node) == {"lit"} and (node["lit"] is None or isinstance(node["lit"], (str, int, float, bool))):
        return F.lit(node["lit"])
    raise ValueError(f"not a column or literal: {node!r}")


def predicate(node: dict) -> Column:
    """Compile ``and, or, not, cmp, in, between, is_null`` nodes to one expression."""
    match node.get("op"):
        case "and" | "or" as op:
            if not node["args"]:
                raise ValueError(f"{op} needs arguments")
            return reduce(operator.and_ if op == "and" else operator.or_, map(predicate, node["args"]))
        case "not":
            return ~predicate(node["arg"])
        case "cmp":
            return _COMPARE[node["cmp"]](_leaf(node["left"]), _leaf(node["right"]))
        case "in":
            if not node["values"]:
                raise ValueError("in needs values")
            return _leaf(node["arg"]).isin([_leaf(v) for v in node["values"]])
        case "between":
            return _leaf(node["arg"]).between(_leaf(node["low"]), _leaf(node["high"]))
        case "is_null":
            return _leaf(node["arg"]).isNull()
    raise ValueError(f"unknown predicate {node.get('op')!r}")


def _split(df: DataFrame, keep: Column, rule: Rule, reason: str) -> tuple[DataFrame, DataFrame]:
    sure = F.coalesce(keep, F.lit(False))
    rejected = df.where(~sure).withColumns({"reason_code": F.lit(reason), "rule_id": F.lit(rule.rule_id)})
    return df.where(sure), rejected


def validity_filter(df: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Rows whose predicate is true stay; false and unknown ones are rejected."""
    return _split(df, predicate(rule.spec["where"]), rule, rule.spec.get("reason_code", "invalid"))


def vocab_map(df: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Translate codes by an exact map that the rule holds; duplicates are refused.

    Unmapped codes are rejected, or become null with ``passthrough``.
    """
    pairs = rule.spec["map"]
    if len({k for k, _ in pairs}) != len(pairs):
        raise ValueError(f"{rule.rule_id}: a code is mapped twice")
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    found = F.try_element_at(table, F.col(rule.spec["column"])) if pairs else F.lit(None).cast("string")
    out = df.withColumn(rule.spec["into"], found)
    if rule.on_fail == "passthrough":
        return out, out.limit(0).withColumns({"reason_code": F.lit(""), "rule_id": F.lit("")})
    return _split(out, F.col(rule.spec["into"]).isNotNull(), rule, "unmapped_code")


def alias_join(df: DataFrame, rule: Rule, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Left join to aliases at or above a confidence; an ambiguous key is refused."""
    keys, value = rule.spec["keys"], rule.spec["value"]
    sure = aliases.where(F.col("confidence") >= rule.spec["min_confidence"]).select(*keys, value)
    if sure.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"{rule.rule_id}: alias key is ambiguous")
    out = df.join(sure, keys, "left")
    if rule.on_fail == "passthrough":
        return out, out.limit(0).withColumns({"reason_code": F.lit(""), "rule_id": F.lit("")})
    return _split(out, F.col(value).isNotNull(), rule, "alias_unmatched")


def unit_conform(df: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    s = rule.spec
    kind = df.schema[s["column"]].dataType.simpleString()
    value = scaled(s["column"], s["factor"], s["scale"], s.get("rounding", "half_up")).cast(kind)
    return _split(df.withColumn(s["column"], value), F.lit(True), rule, "")


def key_composite(df: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    s = rule.spec
    out = df.withColumn(s["into"], composite_key([(c, w) for c, w in s["parts"]], s.get("charset", "0-9"), s.get("min_width", 1)))
    return _split(out, F.col(s["into"]).isNotNull(), rule, "bad_key")


def header_policy(df: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """All rows are rejected where the header lacks, or with ``declared`` exceeds, the declared columns."""
    declared, actual = set(rule.spec["columns"]), set(df.columns)
    fits = declared <= actual if rule.spec.get("policy", "contains") == "contains" else declared == actual
    return _split(df, F.lit(fits), rule, "schema_mismatch")


def bounded_fields(df: DataFrame, rule: Rule, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Null or drop measures out of their bounds; each breach is a reject of its own."""
    bad = {}
    for b in rule.spec["bounds"]:
        v = F.col(b["column"])
        top = F.col(b["max_column"]) if "max_column" in b else F.lit(b.get("max"))
        low = F.lit(b["min"]) if b.get("min") is not None else None
        over = F.coalesce(v > top, F.lit(False)) if b.get("max") is not None or "max_column" in b else F.lit(False)
        bad[b["column"]] = over | (F.coalesce(v < low, F.lit(False)) if low is not None else F.lit(False))
    breaches = F.filter(
        F.array(*[F.when(x, F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("filed"))) for c, x in bad.items()]), lambda s: s.isNotNull()
    )
    rejected = df.select(*key, F.explode(breaches).alias("b")).select(*key, "b.field", "b.filed")
    rejected = rejected.withColumns({"reason_code": F.lit("out_of_bounds"), "rule_id": F.lit(rule.rule_id)})
    if rule.spec.get("action", "null_field") == "drop_row":
        return df.where(~reduce(operator.or_, bad.values())), rejected
    return df.withColumns({c: F.when(~x, F.col(c)) for c, x in bad.items()}), rejected


def first_failing(checks: list[tuple[str, Column]]) -> Column:
    """The reason of the first check that isn't true; null where all are."""
    return reduce(lambda acc, rc: acc.when(~F.coalesce(rc[1], F.lit(False)), rc[0]), checks[1:], F.when(~F.coalesce(checks[0][1], F.lit(False)), checks[0][0]))


def read_or_reject(df: DataFrame, key: list[str], fields: dict[str, tuple[str, float | None]]) -> tuple[DataFrame, DataFrame]:
    """Typed measures from text: blank is an absence, what can't be read is nulled and listed.

    ``fields`` maps a text column to its type and a strict upper bound.
    """
    parsed, tests = {}, []
    for c, (kind, most) in fields.items():
        raw = F.trim(F.col(c))
        value = raw.try_cast(kind)
        unread = (raw != "") & value.isNull()
        over = value > F.lit(most) if most is not None else F.lit(False)
        reason = F.when(unread, "unreadable").when(F.coalesce(over, F.lit(False)), "implausible")
        parsed[c] = F.when(reason.isNull() & (raw != ""), value)
        tests.append(F.when(reason.isNotNull(), F.struct(F.lit(c).alias("field"), F.col(c).alias("filed"), reason.alias("reason_code"))))
    rejected = df.select(*key, F.explode(F.filter(F.array(*tests), lambda s: s.isNotNull())).alias("r")).select(*key, "r.*")
    return df.withColumns(parsed), rejected


def datum_transform(df: DataFrame, rule: Rule, grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Move points to another datum by a shift grid (``datum.shifted``); what it can't place is quarantined.

    ``spec``: ``x, y, source, target, step`` and ``inverse``. Datums that are
    listed in ``same`` with each other (``[["NAD83", "WGS84"]]``) need no move;
    points without coordinates pass as they are.
    """
    spec = rule.spec
    pair = {spec["source"], spec["target"]}
    if len(pair) == 1 or any(pair <= set(known) for known in spec.get("same", [])):
        return df, df.limit(0).withColumns({"reason_code": F.lit(""), "rule_id": F.lit("")})
    moved = datum.shifted(df, spec["x"], spec["y"], grid, spec["step"], inverse=spec.get("inverse", False), out=("__mx", "__my"), fact="__fact")
    kept, rejected = _split(moved, F.col("__fact") != "datum_undetermined", rule, "datum_undetermined")
    return kept.withColumns({spec["x"]: F.col("__mx"), spec["y"]: F.col("__my")}).drop("__mx", "__my", "__fact"), rejected.drop("__mx", "__my", "__fact")


EXECUTORS: dict[str, Callable[[DataFrame, Rule], tuple[DataFrame, DataFrame]]] = {
    "validity_filter": validity_filter,
    "vocab_map": vocab_map,
    "unit_conform": unit_conform,
    "key_composite": key_composite,
    "parse_directive": header_policy,
}


#: Kinds that need a frame besides the one they work on; ``spec.frame`` names it.
WITH_FRAME: dict[str, Callable[[DataFrame, Rule, DataFrame], tuple[DataFrame, DataFrame]]] = {
    "alias_join": alias_join,
    "datum_transform": datum_transform,
}


def apply_rules(df: DataFrame, rules: list[Rule], frames: dict[str, DataFrame] | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """Apply rules in order; rejected rows leave the frame, policy-only rules pass.

    ``frames`` holds the alias tables and shift grids that rules name.
    """
    rejected = []
    for rule in rules:
        if rule.kind == "code_ref":
            continue
        if rule.kind in WITH_FRAME:
            name = rule.spec.get("frame")
            if name not in (frames or {}):
                raise ValueError(f"{rule.rule_id}: no frame {name!r}")
            df, out = WITH_FRAME[rule.kind](df, rule, frames[name])
        elif rule.kind in EXECUTORS:
            df, out = EXECUTORS[rule.kind](df, rule)
        else:
            raise ValueError(f"no executor for {rule.kind!r}")
        rejected.append(out)
    return df, rejected
