"""Mixing sources to target weights by Sainte-Lague apportionment of blocks.

Words are the unit. Targets follow the weights of the sources and stop at a
multiple of a source's own size; a source at that stop gives every document that
many times. What the others have to give is cut into blocks of equally many
words, and each block goes to the source with the highest quotient
weight / (2 seats + 1). A source's blocks are whole passes over its documents
first; those left over go to its shards by the same rule.

The documents of a source stand end to end in a seeded order, cut into blocks
and these into shards, so all but the last block are full however short the
documents are. A shard's quota is spent on neighbouring blocks from a seeded one
on, so few documents are cut.

Nothing is collected: the plan is a table of one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreline.llm.rows import column
from oreline.storage import written

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 64
SHARD_BLOCKS = 4096
#: Hexadecimal digits of the order key that deal a source's rows to tasks.
_DEAL = 4

def _over_all(c: Column) -> Column:
    return c.over(Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def _wide(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def _per(a: Column, b: Column) -> Column:
    """Whole quotient of longs that are not negative."""
    return F.call_function("div", a, b)


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """``source, source_size`` with ``place, weight, capped, target`` and ``left, weights``.

    Sources stand by code point, null last, and take the weights in turn. They
    share the sum of all sizes; targets above ``cap`` times a source's size stop
    there and the excess is reshared among the others until none is above. That
    is the level at which the sources fill up: they are taken by the ratio of cap
    to weight, and one is capped if its share of what those before it leave is
    above its cap. ``left`` is what the others share, ``weights`` their sum.

    The windows over all sources see one row per source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    limit = F.lit(cap) * F.col("source_size")
    by_limit = Window.orderBy("fills", "place")
    before, upto = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(Window.unboundedPreceding, 0)
    out = sources.withColumn("place", place).withColumn("weight", weight.cast("long")).withColumn("fills", limit / F.col("weight"))
    spent, used = F.coalesce(F.sum(limit).over(before), F.lit(0)), F.coalesce(F.sum("weight").over(before), F.lit(0))
    out = out.withColumns({"words": _over_all(F.sum("source_size")) - spent, "weights": _over_all(F.sum("weight")) - used})
    over = _wide("weight") * _wide("words") > _wide(limit) * _wide("weights")
    out = out.withColumn("over", over).withColumn("capped", F.min("over").over(upto))
    free = ~F.col("capped")
    out = out.withColumn("left", _over_all(F.sum("source_size")) - F.coalesce(_over_all(F.sum(F.when(~free, limit))), F.lit(0)))
    out = out.withColumn("weights", _over_all(F.sum(F.when(free, F.col("weight"))))).drop("words", "over", "fills")
    share = (F.col("weight") * F.col("left")).cast("double") / F.col("weights").cast("double")
    return out.withColumn("target", F.when(free, share).otherwise(limit.cast("double")))


def quotas(goals: DataFrame, cap: int = 3, block: int = BLOCK_WORDS) -> DataFrame:
    """Add ``quota``, the words that each source gives: its seats times the block.

    Seats go by the highest quotients weight / (2 seats + 1), ties to the earlier
    source; what is left of the last block goes to the next one in line. With n
    sources and N seats a source has (N - n/2) times its share at least and
    (N + n/2) times its share at most, each rounded; only the quotients between
    these are ranked, about two per source. Capped sources give their cap.
    """
    free = goals.where("NOT capped").withColumn("n", _over_all(F.count("*"))).withColumn("seats", _per(F.col("left"), F.lit(block)))
    both = 2 * F.col("weights")
    least = F.when(2 * F.col("seats") > F.col("n"), _per(F.col("weight") * (2 * F.col("seats") - F.col("n")) + F.col("weights"), both)).otherwise(0)
    most = _per(F.col("weight") * (2 * F.col("seats") + 2 + F.col("n")) + F.col("weights"), both)
    free = free.withColumn("held", least.cast("long")).withColumn("open", F.col("seats") - _over_all(F.sum("held")))
    line = free.select("place", "open", "weight", F.explode(F.sequence(F.col("held"), most)).alias("seat"))
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("weight") / (2 * F.col("seat") + 1)), "place", "seat"))
    line = line.withColumn("rank", rank).where(F.col("rank") <= F.col("open") + 1)
    won = line.groupBy("place").agg(F.count_if(F.col("rank") <= F.col("open")).alias("won"), F.bool_or(F.col("rank") == F.col("open") + 1).alias("next"))
    given = free.join(won, "place", "left").select(
        "place",
        ((F.col("held") + F.coalesce("won", F.lit(0))) * block + F.when(F.col("next"), F.col("left") % block).otherwise(0)).alias("given"),
    )
    limit = F.lit(cap) * F.col("source_size")
    return goals.join(given, "place", "left").withColumn("quota", F.least(F.coalesce("given", limit), limit)).drop("given")


def _shares(seats: Column, block: int, shard: int) -> Column:
    """Seats of a source's shards: ``each`` of the full ones, one ``more`` for the first, ``last``.

    Sainte-Lague between ``full`` equal shards and a last, smaller one has a
    closed form: before the full shards get their (k+1)-th seats, the last one
    has as many as there are odd numbers below (2k + 1) times its relative size.
    Shards hold no more seats than full blocks; what one can't hold others get.
    """
    size, full, last = F.lit(shard * block).cast("long"), F.col("full"), F.col("last")

    def before(k: Column) -> Column:
        odd = F.when(last > 0, _per(_per(last * (2 * k + 1) - 1, size) + 1, F.lit(2))).otherwise(0)
        return odd.cast("long")

    about = _per(seats * size, F.greatest(F.lit(1), F.col("source_size")))
    near = F.sequence(F.greatest(F.lit(0).cast("long"), about - 2), about + 2)
    rounds = F.array_max(F.filter(near, lambda k: full * k + before(k) <= seats))
    in_round = seats - full * rounds - before(rounds)
    free = F.when(full == 0, seats).otherwise(before(rounds) + F.greatest(F.lit(0), in_round - full))
    held = F.greatest(seats - full * shard, F.least(free, _per(last, F.lit(block))))
    others = F.greatest(F.lit(1), full)
    return F.struct(_per(seats - held, others).alias("each"), ((seats - held) % others).alias("more"), held.alias("last"))


def plan(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, block: int = BLOCK_WORDS, shard: int = SHARD_BLOCKS) -> DataFrame:
    """One row per source: target, whole passes, and the seats of its shards for the rest."""
    quota = quotas(targets(sources, weights, cap), cap, block)
    size = F.greatest(F.lit(1), F.col("source_size"))
    out = quota.withColumns({"passes": _per(F.col("quota"), size), "rest": F.col("quota") % size})
    out = out.withColumns({"full": _per(F.col("source_size"), F.lit(shard * block)), "last": F.col("source_size") % (shard * block)})
    seats = _per(F.col("rest"), F.lit(block))
    return out.select(
        "source", "source_size", "target", "quota", "passes", "full", "last",
        (F.col("rest") % block).alias("part"), _shares(seats, block, shard).alias("now"), _shares(seats + 1, block, shard).alias("then"),
    )


def _taken_of(p: Column, j: Column, block: int, shard: int, seed: int) -> Column:
    """Words that the rest takes of block ``j`` of a source, from the block's start."""
    number, at = _per(j, F.lit(shard)), j % shard
    is_last = number == p["full"]
    blocks = F.when(is_last, _per(p["last"], F.lit(block))).otherwise(F.lit(shard))

    def seats(s: Column) -> Column:
        return F.when(is_last, s["last"]).otherwise(s["each"] + F.when(number < s["more"], 1).otherwise(0))

    rank = F.when(at < blocks, (at + number * 7919 + seed) % F.greatest(blocks, F.lit(1))).otherwise(blocks)
    part = F.when((rank == seats(p["now"])) & (seats(p["then"]) > seats(p["now"])), p["part"]).otherwise(0)
    return F.when(rank < seats(p["now"]), block).otherwise(part).cast("long")


def mixed(
    docs: DataFrame,
    keep: tuple[str, ...] | None = None,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    cap: int = 3,
    block: int = BLOCK_WORDS,
    shard: int = SHARD_BLOCKS,
    seed: int = 8,
) -> DataFrame:
    """Every row with the words that the mix takes of it.

    Returns ``row`` (a struct of the input's columns, or of those in ``keep``,
    under whatever names), ``size, source_size, target, taken`` and, for
    ``taken_texts``, ``passes`` and ``cuts`` (from where and how many words of
    the row the last pass takes).

    Null and empty texts have size 0 and are never taken; a null source is a
    source of its own and stands last. Repeated rows are rows of their own. Rows
    stand by a digest of seed, id and text, then by a hash of ``row``, so reruns
    agree and rows without an id are spread like others. The words taken of a source come within one block
    of its quota, which is within a block of its target; no row exceeds ``cap``
    times its size. An empty table gives an empty one.

    A source's rows are dealt to tasks by the first digits of their digest, so a
    source with a third of all rows is spread. Between the two passes one row per
    source and digits (65,536 at most per source) is written.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))).cast("binary"))
    rows = docs.select(
        F.struct(*map(column, keep or docs.columns)).alias("row"),
        F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("of"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        key.alias("key"),
    ).withColumn("deal", F.substring("key", 1, _DEAL))
    dealt = written(rows.groupBy("of", "source", "deal").agg(F.sum("size").alias("words")), "mix-words")
    sources = dealt.groupBy("of", "source").agg(F.sum("words").alias("source_size"))
    spending = plan(sources.select("source", "source_size"), weights, cap, block, shard).withColumn("of", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    # running sums over the digits in two steps, so that a source's rows here do not meet in one task
    tops = dealt.groupBy("of", F.substring("deal", 1, _DEAL // 2).alias("top")).agg(F.sum("words").alias("words"))

    def earlier(by: list[str], order: str) -> Column:
        return F.coalesce(F.sum("words").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    tops = tops.withColumn("above", earlier(["of"], "top")).drop("words")
    steps = dealt.drop("source").withColumn("top", F.substring("deal", 1, _DEAL // 2))
    steps = steps.withColumn("within", earlier(["of", "top"], "deal")).drop("words")
    offsets = steps.join(tops, ["of", "top"]).select("of", "deal", (F.col("above") + F.col("within")).alias("offset"))
    placed = rows.join(offsets.join(spending, "of"), ["of", "deal"])
    inside = Window.partitionBy("of", "deal").orderBy("key", "size", F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    p = F.struct("full", "last", "part", "now", "then")
    placed = placed.withColumn("start", start).withColumn("p", p)
    begin, end = F.col("start"), F.col("start") + F.col("size")

    def cut(j: Column) -> Column:
        first = F.greatest(begin, j * block)
        n = F.least(end, j * block + _taken_of(F.col("p"), j, block, shard, seed)) - first
        return F.struct((first - begin).alias("at"), F.greatest(F.lit(0).cast("long"), n).alias("n"))

    blocks = F.sequence(_per(begin, F.lit(block)), _per(end - 1, F.lit(block)))
    spends = (F.col("part") > 0) | (F.col("now.last") > 0) | (F.col("now.each") > 0) | (F.col("now.more") > 0)
    none = F.lit(None).cast("array<struct<at:bigint,n:bigint>>")
    placed = placed.withColumn("cuts", F.when((F.col("size") > 0) & spends, F.filter(F.transform(blocks, cut), lambda c: c["n"] > 0)).otherwise(none))
    of_rest = F.aggregate(F.coalesce("cuts", F.array().cast("array<struct<at:bigint,n:bigint>>")), F.lit(0).cast("long"), lambda acc, c: acc + c["n"])
    return placed.select("row", "size", "source_size", "target", (F.col("passes") * F.col("size") + of_rest).alias("taken"), "passes", "cuts")


def taken_texts(mix: DataFrame, *, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """Rows of the mix itself: whole copies and, last, the part of the last pass.

    A row that the mix takes k times over and in part gives k rows and one with
    the words of its chosen blocks; rows not taken are left out. Columns are
    those of ``row`` as they were, but for the text and ``n_chars``, which
    follows it where the input has it.
    """
    words = F.regexp_extract_all(F.col("row").getField(text), F.lit(f"({WORD})"), F.lit(1))
    pieces = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform("cuts", lambda c: F.slice(w, (c["at"] + 1).cast("int"), c["n"].cast("int")))), " "))
    whole = F.col("row").getField(text)
    extra = F.col("taken") - F.col("passes") * F.col("size")
    last = F.when(extra == F.col("size"), F.array(whole)).when(extra > 0, pieces).otherwise(F.array().cast("array<string>"))
    copies = F.concat(F.array_repeat(whole, F.col("passes").cast("int")), last)
    rows = mix.where("taken > 0").select("row", F.explode(copies).alias("copy"))
    columns = mix.schema["row"].dataType.names

    def value(name: str) -> Column:
        if name == text:
            return F.col("copy").alias(name)
        if name == n_chars:
            return F.char_length("copy").cast("long").alias(name)
        return F.col("row").getField(name).alias(name)

    return rows.select(*map(value, columns))
