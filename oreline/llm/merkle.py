"""Merkle manifest of a dataset, with a proof for every row.

Rows are leaves, in the order of their ids within their language. A language's
leaves are cut into aligned blocks of 8^4; each block is walked in postorder,
one block a task's group: a subtree returns its digest, and while the walk
unwinds each inner node appends the siblings of its children to the leaves
below them. The block roots are the nodes of the next walk, and so on until a
language has one node left; the languages' subroots are walked in the same way.
A leaf's proof is what the walks appended to it, its block and its language.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreline.llm.ordering import numbered
from oreline.llm.rows import column
from oreline.storage import Passes

ARITY = 8
HEIGHT = 4
BLOCK = ARITY**HEIGHT
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(nodes: list[bytes]) -> bytes:
    """Digest of nodes that are given, and returned, as lowercase hex."""
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


def depth(nodes: int) -> int:
    """Rounds until one of ``nodes`` is left."""
    rounds = 0
    while nodes > 1:
        nodes, rounds = -(-nodes // ARITY), rounds + 1
    return rounds


def walk(leaves: list[bytes], height: int, proofs: list[list[bytes]], first: int = 0) -> bytes:
    """Digest of the subtree over ``leaves[first:first + 8^height]``.

    Postorder: children first; then each leaf below a child gets the child's
    siblings, left to right, at the end of its proof.
    """
    if not height:
        return leaves[first]
    width = ARITY ** (height - 1)
    starts = range(first, min(first + ARITY * width, len(leaves)), width)
    children = [walk(leaves, height - 1, proofs, start) for start in starts]
    for i, start in enumerate(starts):
        siblings = children[:i] + children[i + 1 :]
        for leaf in range(start, min(start + width, len(leaves))):
            proofs[leaf] += siblings
    return digest(children)


def folded(leaf: bytes, proof: list[bytes], places: list[tuple[int, int]]) -> bytes:
    """The root that a leaf and its proof give; ``places`` holds the leaf's place and its level's size, by tree."""
    at = 0
    for place, nodes in places:
        while nodes > 1:
            in_run = min(ARITY, nodes - place // ARITY * ARITY)
            mine = place % ARITY
            run = proof[at : at + in_run - 1]
            leaf = digest([*run[:mine], leaf, *run[mine:]])
            at += in_run - 1
            place, nodes = place // ARITY, -(-nodes // ARITY)
    return leaf


def _walked(nodes: DataFrame) -> DataFrame:
    """Walk each block of ``grp, pos, n, digest``: adds ``block``, ``proof`` (raw digests) and ``top``.

    ``n`` is the number of nodes of the group. A group of several blocks climbs
    to the blocks' height; one of a single block until one node is left.
    """
    source = nodes.withColumn("block", F.expr(f"pos div {BLOCK}"))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos").combine_chunks()
        leaves = [d.hex().encode() for d in table["digest"].to_pylist()]
        proofs: list[list[bytes]] = [[] for _ in leaves]
        total = table["n"][0].as_py()
        top = walk(leaves, HEIGHT if total > BLOCK else depth(total), proofs)
        raw = [bytes.fromhex(b"".join(p).decode()) for p in proofs]
        return table.append_column("proof", pa.array(raw, pa.binary())).append_column("top", pa.array([bytes.fromhex(top.decode())] * len(leaves), pa.binary()))

    return source.groupBy("grp", "block").applyInArrow(run, ", ".join([*fields, "proof binary", "top binary"]))


def _roots(walked: DataFrame) -> DataFrame:
    """The block roots of a walk, as nodes of the next one."""
    size = F.expr(f"(n + {BLOCK - 1}) div {BLOCK}")
    return walked.where(F.col("pos") == F.col("block") * BLOCK).select("grp", F.col("block").alias("pos"), size.alias("n"), F.col("top").alias("digest"))


def _paths(nodes: DataFrame, passes: Passes) -> DataFrame:
    """``grp, pos, n, proof, top`` of every node: its siblings up to its group's root, and that root."""
    walked = passes.write(_walked(nodes), "walked")
    here = walked.select("grp", "pos", "n", "block", "proof", "top")
    if not walked.where(F.col("n") > BLOCK).limit(1).count():
        return here.drop("block")
    above = _paths(_roots(walked), passes).select("grp", F.col("pos").alias("block"), F.col("proof").alias("more"), F.col("top").alias("root"))
    return here.join(above, ["grp", "block"]).select("grp", "pos", "n", F.concat("proof", "more").alias("proof"), F.col("root").alias("top"))


def leaf_text(*values: Column) -> Column:
    """The columns of a row written one behind the other, each with its length."""

    def field(value: Column) -> Column:
        written = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(written).cast("string"), F.lit(":"), written), F.lit("-"))

    return F.concat(*map(field, values))


def manifest(docs: DataFrame, *, doc_id: str = "doc_id", group: str = "lang", text: str = "text", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: Column | None = None) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and the root that its proof folds to.

    Returns ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.
    ``tampered`` holds a changed text for rows that are to be checked in a
    changed state, null for the others; a row whose text it leaves as it is
    still verifies.

    Null columns are written ``-``; rows without a language form the first
    tree, rows without an id come first in theirs. Rows of one id are ordered
    by leaf, and equal rows have equal proofs up to their place; each is a leaf
    of its own. Other columns are ignored; an empty table gives an empty result.

    Rows leave the JVM as digests only. Leaves are numbered by a range sort, so
    a language that holds most rows is dealt out like any other, and every walk
    sees blocks of 4,096 nodes at most.
    """
    passes = Passes(docs.sparkSession, "merkle")
    texts = {text: F.coalesce(tampered, column(text))} if tampered is not None else {}
    changed = tampered.isNotNull() if tampered is not None else F.lit(False)
    leaf = lambda with_: F.unhex(F.sha2(leaf_text(*(with_.get(c, column(c)) for c in columns)).cast("binary"), 256))
    leaves = passes.write(
        docs.select(
            column(doc_id).alias("doc_id"),
            F.coalesce(F.concat(F.lit("1"), column(group).cast("string")), F.lit("0")).alias("grp"),
            leaf({}).alias("digest"),
            F.when(changed, leaf(texts)).alias("changed"),
            F.monotonically_increasing_id().alias("spread"),
        ),
        "leaves",
    )
    lined = numbered(leaves, ["grp", "doc_id", "digest", "spread"], passes, "lined").withColumn("chunk", F.expr(f"at div {BLOCK}"))
    # A language's first place and size come back by stretches of rows, never to all its rows at once.
    stretches = lined.groupBy("grp", "chunk").agg(F.min("at").alias("low"), F.count("*").alias("rows"))
    sizes = stretches.groupBy("grp").agg(F.min("low").alias("start"), F.sum("rows").alias("n"))
    sized = stretches.select("grp", "chunk").join(sizes, "grp")
    placed = lined.join(sized, ["grp", "chunk"]).select("grp", (F.col("at") - F.col("start")).alias("pos"), "n", "digest", "doc_id", "changed")

    walked = passes.write(_walked(placed), "walked-leaves")
    passes.drop("leaves", "lined")
    blocks = passes.write(_paths(_roots(walked), passes), "blocks")
    groups = blocks.where("pos = 0").select(F.col("grp").alias("of"), F.col("top").alias("digest"))
    ranked = passes.write(numbered(groups, ["of"], passes, "groups", place="pos"), "ranked")
    several = ranked.count()
    tree = ranked.select(F.lit("").alias("grp"), "pos", F.lit(several).cast("long").alias("n"), "digest")
    tops = _paths(tree, passes).select("pos", F.col("proof").alias("over"), F.col("top").alias("root"))
    named = ranked.select("of", "pos").join(tops, "pos").select(F.col("of").alias("grp"), F.col("pos").alias("group_pos"), "over", "root")
    above = blocks.join(named, "grp").select("grp", F.col("pos").alias("block"), F.concat("proof", "over").alias("more"), F.col("top").alias("subroot"), "group_pos", "root")
    full = walked.drop("top").join(above, ["grp", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, change, proofs, subroots, roots = ([None if v is None else v.hex().encode() for v in batch.column(i).to_pylist()] for i in (1, 2, 3, 7, 8))
            out = []
            for i, (pos, n, at) in enumerate(zip(*(batch.column(k).to_pylist() for k in (4, 5, 6)))):
                nodes = [proofs[i][j : j + 64] for j in range(0, len(proofs[i]), 64)]
                out.append(folded(change[i] or own[i], nodes, [(pos, n), (at, several)]).decode())
            proof = [hashlib.sha256(p).hexdigest() for p in proofs]
            hexes = [[v.decode() for v in values] for values in (own, subroots, roots)]
            same = [a == b for a, b in zip(out, hexes[2])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (*hexes, proof, out)), pa.array(same, pa.bool_())], names)

    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    kind = docs.schema[doc_id].dataType.simpleString()
    source = full.select("doc_id", "digest", "changed", F.concat("proof", "more"), "pos", "n", "group_pos", "subroot", "root")
    return source.mapInArrow(run, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def lower_cased_thirds(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text with A-Z lower-cased where 3 divides the id's crc32; null elsewhere, and where the text is null."""
    return F.when(F.crc32(column(doc_id).cast("string").cast("binary")) % 3 == 0, F.translate(column(text), _UPPER, _LOWER))
