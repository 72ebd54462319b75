"""Near copies by shingle sets: MinHash bands propose pairs, exact sets decide.

Two texts are near copies if the sets of their five-word shingles have a Jaccard
similarity of 0.8 or more. Texts with equal sets are one node from the start. A
node has 180 least hashes in 30 bands of six; nodes that agree in a whole band
share a bucket. A pair at similarity 0.8 shares none of its buckets in about one
case in 10,000 (by calculation: (1 - 0.8^6)^30), one at 0.9 practically never.

Nodes of a bucket are first compared with its centre only, the node with the
most neighbours over all its buckets, which is the original of a group of edited
copies where the table has it. Nodes of different components that are still
together form a group under that centre; groups of linked centres are one. Two of
them can only be alike if they share a shingle that the centre lacks, or if the
centre holds enough of both: so the group is dealt into cells, by the shingles
that the centre lacks and that members of several components share, the rarest
first, and by size; each cell gets a centre of its own, and so on. Each round is
linear in the shingles that are left. Cells of a dozen nodes, or of a dozen
partners a member on average, are compared in pairs, and so are those that still
hold several components after a few rounds.
Each link is checked on the exact sets. Before that, pairs are compared on their
least hashes, a byte each; but for that (one pair in 10^13) no pair of the
buckets that may be alike is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreline.llm import simhash
from oreline.llm.rows import column, packed, schema_with, unpacked
from oreline.operators.graph import connected_components
from oreline.storage import Passes, written

SHINGLE = 5
BANDS, ROWS = 30, 6
_RANDOM = np.random.default_rng(9)
_FACTOR = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)
_MIX = _RANDOM.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_AT_ONCE = 2048
#: Rounds of cells with centres before what is left apart is compared in pairs.
ROUNDS = 4
#: Of the 180 least hashes, how many a pair must share to be compared on its sets.
LEAST_AGREED = 98
#: Members that are compared in pairs at once.
FEW = 12
#: Sizes of one cell differ by two per cent.
SIZE_STEP = float(np.log(1.02))


def shingles(text: str | None) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles of one whole text, in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII case and space only
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        hashes = [digest(joined, 42)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1)
        starts = ends - lengths - 1
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts.tolist(), (ends[SHINGLE - 1 :] - 1).tolist())]
    return np.unique(np.array(hashes, np.uint64))


def bands(found: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The bucket of a shingle set in each band, and a byte of each of its least hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), _AT_ONCE):
        least = np.minimum(least, (found[None, at : at + _AT_ONCE] * _FACTOR + _SHIFT).min(axis=1))
    key = (((least ^ least >> np.uint64(31)).reshape(BANDS, ROWS)) * _MIX).sum(axis=1, dtype=np.uint64)
    return (key ^ key >> np.uint64(29)).view(np.int64), (least >> np.uint64(8)).astype(np.uint8).tobytes()


def _marked(docs: DataFrame, text: str, doc_id: str, fingerprints: bool) -> DataFrame:
    """Packed rows with their place, the 128-bit hash and size of their shingle set, its buckets, and the fingerprint of the text if asked for."""
    source = packed(docs, place=F.monotonically_increasing_id(), id=column(doc_id), by_text=F.xxhash64(column(text)), text=column(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(4)]
            node = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            marks = [bands(s) for s in sets]
            keys = np.concatenate([k for k, _ in marks]) if sets else np.zeros(0, np.int64)
            sketches = pa.array([b for _, b in marks], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys))
            prints = pa.array(np.array([simhash.text_fingerprint(t.as_py()) if fingerprints else 0 for t in batch.column(4)], "<u8").view("<i8"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(node, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), lists, sketches, prints], [*batch.schema.names[:4], "node", "size", "bands", "sketch", "fp"])

    return source.mapInArrow(run, schema_with(source.drop("text"), "node binary, size bigint, bands array<bigint>, sketch binary, fp bigint"))


def _fingerprint_links(rows: DataFrame, tables: Passes) -> DataFrame:
    """``a < b``: nodes with the least node of their fingerprint, and the least nodes of linked fingerprints."""
    seen = tables.write(rows.select("fp", "node").distinct(), "fingerprints")
    least = tables.write(seen.groupBy("fp").agg(F.min("node").alias("least")), "least-nodes")
    close = simhash.linked_pairs(least.select("fp"))
    end = lambda fp, name: least.select(F.col("fp").alias(fp), F.col("least").alias(name))
    between = close.join(end("a", "x"), "a").join(end("b", "y"), "b").select("x", "y")
    both = seen.join(least, "fp").select("least", "node").union(between).where("least <> node")
    return both.select(F.least("least", "node").alias("a"), F.greatest("least", "node").alias("b")).distinct()


def _shingle_rows(texts: DataFrame) -> DataFrame:
    """``node, found`` of ``node, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingles(t.as_py()).view(np.int64) for t in part.column(1)]
                ends = np.cumsum([0, *map(len, sets)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["node", "found"])

    return texts.mapInArrow(run, "node binary, found array<bigint>")


def _with_hub(rows: DataFrame, hub: str, table: DataFrame, column_: str, other: str, name: str) -> DataFrame:
    """``rows`` with what ``table`` has for their ``hub`` in ``column_``, as ``name``.

    A hub's rows are dealt out by a hash of ``other``, and its value goes once to
    every such part that it has rows in.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64(other), F.lit(parts)))
    places = dealt.select(hub, "deal").distinct().join(table.select(F.col("node").alias(hub), F.col(column_).alias(name)), hub)
    return dealt.join(places, [hub, "deal"]).drop("deal")


def _promising(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those distinct pairs ``node, centre`` that agree in ``LEAST_AGREED`` of their least hashes.

    A pair at similarity 0.8 agrees in 144 of 180 on average, with a deviation of
    5.4: the bound, 8.5 deviations below, costs one pair in 10^13. Sketches are
    a twentieth of the sets, which only promising pairs have to meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for i in (2, 3))
            keep = (x == y).sum(axis=1) >= LEAST_AGREED
            yield batch.select([0, 1]).filter(pa.array(keep))

    own = pairs.join(sketches.select("node", F.col("sketch").alias("x")), "node")
    both = _with_hub(own, "centre", sketches, "sketch", "node", "y").select("node", "centre", "x", "y")
    return both.mapInArrow(run, "node binary, centre binary")


def _alike(pairs: DataFrame, sets: DataFrame, sketches: DataFrame) -> DataFrame:
    """``a, b`` of those distinct pairs ``node, centre`` whose sets have a similarity of 0.8 or more."""
    own = _promising(pairs, sketches).join(sets.select("node", F.col("found").alias("x")), "node")
    both = _with_hub(own, "centre", sets, "found", "node", "y")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(9 * shared >= 4 * (F.size("x") + F.size("y"))).select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))


def _sizes_allow(a: str, b: str):
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def _size_band(size) -> Column:
    return F.floor(F.log(size) / F.lit(SIZE_STEP)).cast("long")


def _open(members: DataFrame, tables: Passes, number: int) -> DataFrame:
    """Members of groups, ``grp, node, size, part, covered, rest``, that may still be alike to one of another component.

    Of ``rest`` only shingles stay that members of different components of the
    group share, rarest first: no pair that is still asked for has another one in
    common. Members that have too few of them, and too little in common with the
    centres, are left out. A shingle that all of a group share is one key of both
    sides of a join; nothing else meets there.
    """
    each = tables.write(members.select("grp", "node", "part", F.explode("rest").alias("found")), f"each-{number}")
    shared = each.groupBy("grp", "found").agg(F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("grp", "found", "n")
    held = each.select("grp", "node", "found").join(shared, ["grp", "found"]).groupBy("grp", "node").agg(F.sort_array(F.collect_list(F.struct("n", "found"))).alias("held"))
    rest = F.coalesce(F.col("held.found"), F.array().cast("array<bigint>"))
    found = members.drop("rest").join(held, ["grp", "node"], "left").select("grp", "node", "size", "part", "covered", rest.alias("rest"))
    return tables.write(found.where((F.size(_leading()) > 0) | (5 * _most_covered() >= 4 * F.col("size"))), f"open-{number}")


def _leading() -> Column:
    """The first shingles of ``rest``, of which two sets share one if they share what each can't do without."""
    needed = F.greatest(F.ceil(4 * F.col("size") / 5) - F.col("covered"), F.lit(1))
    return F.slice("rest", F.lit(1), F.greatest(F.size("rest") - needed + 1, F.lit(0)).cast("int"))


def _most_covered() -> Column:
    """The largest size of a set that is alike by covered shingles only, from 9 * covered >= 4 * (both sizes)."""
    return F.least("size", F.floor(9 * F.col("covered") / 4) - F.col("size"))


def _dealt(members: DataFrame) -> DataFrame:
    """Members of groups, ``grp, node, size, part, covered, rest``, dealt into cells of those that may be alike.

    ``covered`` counts the shingles that one of the group's centres so far has,
    ``rest`` holds those of the others that are shared. Two sets share at most as
    many of the covered ones as either has. Either both have enough of those,
    which bounds the smaller one's size from above: then the larger one goes to
    the cells of all sizes that it allows, the smaller one, which is asked for
    there, to that of its own. Or the pair has so many of ``rest`` in common as
    the others leave open. Then one of them is among the first of both, in an
    order that all sets of a group keep, if each leaves out at the end one less
    than it needs. Cells whose members are one component already, or in which
    none is asked for, are left out.
    """
    size, covered, most = F.col("size"), F.col("covered"), _most_covered()
    none = F.array().cast("array<bigint>")
    allowed = F.when(5 * most >= 4 * size, F.sequence(_size_band(F.ceil(4 * size / 5)), _size_band(most))).otherwise(none)
    own = F.when(9 * covered >= 8 * size, F.array(_size_band(size))).otherwise(none)
    cell = lambda kind, asked: lambda t: F.struct(F.struct(F.lit(kind).alias("kind"), t.alias("at")).alias("cell"), F.lit(asked).alias("asked"))
    cells = F.concat(F.transform(_leading(), cell(0, True)), F.transform(F.array_except(allowed, own), cell(1, False)), F.transform(own, cell(1, True)))
    spread = members.select("grp", "node", "size", "part", "covered", F.size("rest").alias("shares"), F.explode(cells).alias("to")).select("grp", "node", "size", "part", "covered", "shares", "to.*")
    nearest = F.max(F.struct("shares", -size, "node", "size", "part"))  # the one with the most shingles that others have
    counts = [F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high"), F.max("asked").alias("asked"), nearest.alias("centre")]
    several = spread.groupBy("grp", "cell").agg(*counts).where("low < high AND asked").drop("low", "high", "asked")
    return spread.drop("shares").join(several, ["grp", "cell"])


def _pairs(cells: DataFrame, *by: str) -> DataFrame:
    """``node, centre``: all pairs of one cell and different components."""
    other = cells.select(*by, F.col("node").alias("other"), F.col("size").alias("m"), F.col("part").alias("q"))
    differ = (F.col("node") < F.col("other")) & (F.col("part") != F.col("q")) & _sizes_allow("size", "m")
    return cells.select(*by, "node", "size", "part").join(other, [*by]).where(differ).select("node", F.col("other").alias("centre"))


def _covered_pairs(cells: DataFrame) -> DataFrame:
    """``node, centre``: pairs of a size cell that their covered shingles allow, with one that is asked for there."""
    one = cells.select("grp", "cell", "node", "size", "part", "covered")
    other = cells.where("asked").select("grp", "cell", F.col("node").alias("other"), F.col("size").alias("m"), F.col("part").alias("q"), F.col("covered").alias("also"))
    allowed = (F.col("m") <= F.col("size")) & (F.col("part") != F.col("q")) & (9 * F.least("covered", "also") >= 4 * (F.col("size") + F.col("m")))
    return one.join(other, ["grp", "cell"]).where(allowed).select(F.least("node", "other").alias("node"), F.greatest("node", "other").alias("centre"))


def _grouped(large: DataFrame, links: DataFrame) -> DataFrame:
    """``centre, grp``: of the centres linked to a centre, and itself, the one with the most members.

    A family has a centre in each of its buckets, and many of its members are in
    several of them: they are one group, so that a member is dealt out once.
    """
    weights = large.groupBy("centre").agg(F.count("*").alias("weight"))
    other = weights.select(F.col("centre").alias("other"), "weight")
    ends = links.select(F.col("a").alias("centre"), F.col("b").alias("other")).union(links.select("b", "a"))
    beside = ends.join(weights.select("centre"), "centre").join(other, "other").select("centre", "other", "weight")
    best = beside.union(weights.select("centre", F.col("centre").alias("other"), "weight")).groupBy("centre").agg(F.max(F.struct("weight", "other")).alias("best"))
    return best.select("centre", F.col("best.other").alias("grp"))


def _components(members: DataFrame, sets: DataFrame, sketches: DataFrame, links: DataFrame, labels: DataFrame, known: int, tables: Passes) -> DataFrame:
    """Components of ``links`` and of those between members of groups that are not one component.

    ``members`` has ``grp, node, size, part, covered, rest`` and ``centre``, with
    which all of a group have been compared; ``labels`` are the components of the
    first ``known`` links. They are found again only where a round has linked more.
    """
    for number in range(ROUNDS + 1):
        if members.isEmpty():
            break
        seen = _with_hub(members, "centre", sets, "found", "node", "base").withColumn("left", F.array_except("rest", "base"))
        covered = F.col("covered") + F.size("rest") - F.size("left")
        held = tables.write(seen.select("grp", "node", "size", "part", covered.alias("covered"), F.col("left").alias("rest")), f"rest-{number}")
        still = _open(held, tables, number)
        tables.drop(f"rest-{number}", f"each-{number}")
        dealt = tables.write(_dealt(still), f"cells-{number}")
        sharing = dealt.where("cell.kind = 0")
        rows, sharers, pairs = dealt.agg(F.count("*"), F.count_if(F.col("cell.kind") == 0), F.sum(F.when(F.col("cell.kind") == 0, F.col("n") - 1) / 2)).first()
        if not rows:
            break
        last = number == ROUNDS or (pairs or 0) <= FEW * sharers
        settled = _covered_pairs(dealt.where("cell.kind = 1")).union(_pairs(sharing if last else sharing.where(F.col("n") <= FEW), "grp", "cell"))
        if not last:
            large = sharing.where((F.col("n") > FEW) & (F.col("node") != F.col("centre.node")))
            inner = large.select("grp", F.unhex(F.md5(F.concat("grp", "centre.node"))).alias("inner"), "node", "centre").distinct()
            members = tables.write(inner.join(still, ["grp", "node"]).drop("grp").withColumnRenamed("inner", "grp"), f"members-{number}")
            beside = members.where(_sizes_allow("size", "centre.size") & (F.col("part") != F.col("centre.part"))).select("node", F.col("centre.node").alias("centre"))
            settled = settled.union(beside)
        links = tables.write(links.union(_alike(settled.distinct(), sets, sketches)).distinct(), f"links-{number}")
        tables.drop(f"open-{number}", f"cells-{number}")
        if last:
            break
        members, total = members.withColumn("centre", F.col("centre.node")), links.count()
        if total > known:
            labels, known = connected_components(links, "a", "b").withColumnRenamed("node", "at"), total
            members = members.join(labels, F.col("node") == F.col("at"), "left").withColumn("part", F.coalesce("component", "part")).drop("at", "component")
    if links.count() > known:
        labels = connected_components(links, "a", "b").withColumnRenamed("node", "at")
    return labels


def one_of_each_group(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", fingerprints: bool = False) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    A group is a component of the links at similarity 0.8 or more and, with
    ``fingerprints``, those of SimHash fingerprints at most 2 bits apart: these
    are found first, so nodes that they join are not compared again. Between rows
    of the smallest id the one with the smallest text hash stays; rows without
    an id come last. Texts of up to five words are one shingle; null, empty and
    blank texts are copies of each other. Columns stay as they are; an empty
    table gives an empty one.

    Copies meet as one node before anything is compared. A node is compared with
    the centres of its groups, of which it has no more than buckets, and later
    shingles of its own; the sets of hubs are dealt out with their neighbours.
    Only cells of at most ``ROUNDS`` levels that still hold several components
    are compared in pairs. Rows are written once with their marks; texts are
    shuffled once, for nodes that share a bucket. Rounds join the sets of those
    nodes only that still share a bucket with another component.
    """
    tables = Passes(docs.sparkSession, "near-copies")
    rows = written(_marked(docs, text, doc_id, fingerprints), "near-copy-rows")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "by_text", F.xxhash64("row").alias("by_row"), "place")
    nodes = written(
        rows.select("node", "size", "bands", "sketch", order.alias("best"))
        .groupBy("node")
        .agg(F.min("best").alias("best"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "near-copy-nodes",
    )
    keys = nodes.select("node", "size", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    open_keys = tables.write(keys.join(shared, "key"), "keys")
    degrees = open_keys.groupBy("node").agg(F.sum("n").alias("degree"))
    centres = open_keys.join(degrees, "node").groupBy("key").agg(F.max(F.struct("degree", "node", "size")).alias("centre"))
    buckets = tables.write(open_keys.drop("n").join(centres, "key"), "buckets")
    places = buckets.select("node").distinct().join(nodes.select("node", F.col("best.place").alias("place"), "sketch"), "node")
    sketches = tables.write(places.select("node", "sketch"), "sketches")
    sets = tables.write(_shingle_rows(rows.select("place", F.col("row").getField(text).alias("text")).join(places.drop("sketch"), "place").select("node", "text")), "sets")

    beside = buckets.select("key", "node", "size", F.col("centre.node").alias("centre"), F.col("centre.size").alias("centre_size"))
    printed = tables.write(_fingerprint_links(rows, tables), "fingerprint-links") if fingerprints else None
    stars = _alike(beside.where((F.col("node") != F.col("centre")) & _sizes_allow("size", "centre_size")).select("node", "centre").distinct(), sets, sketches)
    stars = tables.write(stars if printed is None else stars.union(printed).distinct(), "stars")
    labels = connected_components(stars, "a", "b").withColumnRenamed("node", "at")
    labelled = beside.join(labels, F.col("node") == F.col("at"), "left").select("key", "node", "size", "centre", F.coalesce("component", "node").alias("part"))
    others = labelled.where("node <> centre")
    several = others.groupBy("key").agg(F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key", "n")
    still = tables.write(others.join(several, "key"), "still")
    left = tables.write(still.select("node").union(still.select("centre")).distinct(), "left")
    sets, sketches = (tables.write(table.join(left, "node", "left_semi"), f"open-{name}") for name, table in (("sets", sets), ("sketches", sketches)))
    tables.drop("sets", "sketches")
    few = _pairs(still.where(F.col("n") <= FEW), "key")
    large = tables.write(still.where(F.col("n") > FEW).select("node", "size", "part", "centre").distinct(), "large")
    grouped = large.join(_grouped(large, stars), "centre").where("node <> grp")
    moved = grouped.where("centre <> grp").select("node", F.col("grp").alias("centre"))
    first = tables.write(stars.union(_alike(few.union(moved).distinct(), sets, sketches)).distinct(), "few")
    members = grouped.select("grp", "node", "size", "part", F.col("grp").alias("centre")).distinct()
    members = members.join(sets.select("node", F.col("found").alias("rest")), "node").withColumn("covered", F.lit(0))
    groups = _components(members, sets, sketches, first, labels, stars.count(), tables)
    tables.drop_all()
    parts = nodes.join(groups, F.col("node") == F.col("at"), "left").select("best", F.coalesce("component", "node").alias("part"))
    stay = parts.groupBy("part").agg(F.min("best").alias("best")).select(F.col("best.place").alias("place"))
    return unpacked(rows.join(stay, "place", "left_semi"))
