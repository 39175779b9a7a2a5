"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree.

1. A document's size is its number of words. Sources share the words of all documents by
   weight; a target is at most ``limit`` times its source's size and what is cut off is
   shared anew.
2. Each source's documents are dealt by hash into blocks. A source gives whole passes over
   its blocks and one partial pass: blocks in a hashed order while they fit, and of the
   first that does not fit, documents in a hashed order up to the target.
3. A (block, pass) is a unit. The number of units of each source is split between the two
   halves of the output shards by an exact multivariate-hypergeometric draw, then each
   half again, down to single shards; many sources are split group by group. So every shard is a fair sample without replacement
   of all units, and source quotas hold exactly.
4. A shard draws its quota of each source as the next run of that source's permuted units,
   so draws are disjoint. Inside a shard documents stand in a hashed order.

Only Spark SQL functions are used. All randomness is a hash of the seed and the row, so
reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.ordering import rank_rows, running_total
from ..session import write_out

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), limit: float = 3.0) -> DataFrame:
    """(source, source_size, docs, place, target) from (source, source_size, docs).

    Sources take the weights in code point order, null last. With ``w`` the weight, every
    target is ``min(w * level, limit * source_size)``; the level rises until the targets
    add up to the size of all sources. Without words all targets are 0.
    """
    ordered = sizes.withColumn("_null", F.col("source").isNull())
    ranked = rank_rows(ordered, [], ["_null", "source"], "place", sizes.count()).drop("_null")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    table = write_out(ranked.withColumn("_weight", weight).withColumn("_most", limit * F.col("source_size")), "sources")
    total, level = table.agg(F.sum("source_size")).first()[0] or 0, 0.0
    while total:
        over = F.col("_weight") * level > F.col("_most")
        cut, free = table.agg(
            F.sum(F.when(over, F.col("_most")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("_weight")))
        ).first()
        reached = (total - cut) / free if free else level
        if reached <= level:
            break
        level = reached
    target = F.least(F.col("_weight") * level, F.col("_most"))
    return table.withColumn("target", target.cast("double")).drop("_weight", "_most")


def _uniform(*parts: Column | str) -> Column:
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` items out of ``total`` are among the ``marked``, for a uniform ``u``.

    Inverts the distribution in the order mode, above, below. Weights follow from the
    mode by the ratios of neighbours; past 12 standard deviations they are below what a
    double can add to the sum.
    """
    n, k, m = total.cast("double"), marked.cast("double"), drawn.cast("double")
    mode = F.greatest(F.least(F.floor((m + 1) * (k + 1) / (n + 2)), marked, drawn), drawn + marked - total, F.lit(0)).cast("double")
    spread = F.sqrt(m * (k / n) * ((n - k) / n) * ((n - m) / F.greatest(n - 1, F.lit(1.0))))
    start = F.struct(mode.alias("mode"), F.sequence(F.lit(0), (F.ceil(12 * spread) + 2).cast("int")).alias("steps"))

    def up(x: Column) -> Column:
        return (k - x) * (m - x) / ((x + 1) * (n - k - m + x + 1))

    def down(x: Column) -> Column:
        return x * (n - k - m + x) / ((k - x + 1) * (m - x + 1))

    def walk(at: Column, ratio: Callable[[Column], Column], sign: int, goal: Column) -> Column:
        """The sum ``t`` of the weights and the number ``c`` of steps until they reach the goal."""

        def step(a: Column, j: Column) -> Column:
            weight = F.when(a["w"] > 0, F.greatest(a["w"] * ratio(at["mode"] + sign * j), F.lit(0.0))).otherwise(0.0)
            return _let(
                weight,
                lambda w: F.struct(
                    w.alias("w"), (a["t"] + w).alias("t"), (a["c"] + F.when((a["t"] < goal) & (w > 0), 1).otherwise(0)).alias("c")
                ),
            )

        return F.aggregate(at["steps"], F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("t"), F.lit(0).alias("c")), step)

    def choose(at: Column) -> Column:
        sums = F.struct(walk(at, up, 1, F.lit(0.0))["t"].alias("above"), walk(at, down, -1, F.lit(0.0))["t"].alias("below"))

        def place(sums: Column) -> Column:
            mark = u * (1 + sums["above"] + sums["below"])
            return (
                F.when(mark < 1, at["mode"])
                .when(mark < 1 + sums["above"], at["mode"] + walk(at, up, 1, mark - 1)["c"])
                .otherwise(at["mode"] - walk(at, down, -1, mark - 1 - sums["above"])["c"])
            )

        return _let(sums, place)

    none = (total <= 0) | (marked <= 0) | (drawn <= 0)
    return F.when(none, F.lit(0)).otherwise(_let(start, choose)).cast("bigint")


#: Sources that one node's row holds; more are split group by group.
GROUP = 256


def split_quotas(quotas: DataFrame, depth: int, seed: int, group: int = GROUP) -> DataFrame:
    """(shard, place, quota): the units of each source (``place``, ``units``) over 2^depth shards.

    Every node's left half gets half of its units, and how many of each source are among
    them is a multivariate hypergeometric draw. It is made in two steps where there are
    many sources: first for groups of ``group`` sources as a whole, by the same tree (and
    for groups of groups, where there are very many), then inside each group for what it got.
    """
    groups = quotas.select("place", F.col("units").cast("bigint").alias("units"), F.floor((F.col("place") - 1) / group).alias("group"))
    whole = write_out(groups.groupBy("group").agg(F.sum("units").alias("units")), "groups")
    if whole.count() <= 1:
        return _split(groups, None, depth, seed)
    outer = split_quotas(whole.select((F.col("group") + 1).alias("place"), "units"), depth, seed + 101, group)
    outer = write_out(outer.select("shard", (F.col("place") - 1).alias("group"), "quota"), "group-quotas")
    return _split(groups, outer, depth, seed)


def _split(groups: DataFrame, outer: DataFrame | None, depth: int, seed: int) -> DataFrame:
    """The tree of each group. ``outer`` has the units of each group in each shard; without it
    there is one group, and a left half gets half."""
    entry = F.struct("place", "units")
    nodes = groups.groupBy("group").agg(F.sort_array(F.collect_list(entry)).alias("held")).select("group", F.lit(0).cast("bigint").alias("node"), "held")
    for level in range(depth):
        all_units = F.aggregate("held", F.lit(0).cast("bigint"), lambda a, h: a + h["units"])
        if outer is None:
            nodes = nodes.withColumn("goes", F.floor((all_units + F.lit(1)) / 2).cast("bigint"))
        else:  # what the group's shards below the left half have
            below = F.floor(F.col("shard") / 2 ** (depth - level - 1)).cast("bigint")
            lefts = outer.withColumn("below", below).where("below % 2 = 0").groupBy("group", F.floor(F.col("below") / 2).alias("node")).agg(F.sum("quota").alias("goes"))
            nodes = nodes.join(lefts, ["group", "node"], "left").withColumn("goes", F.coalesce("goes", F.lit(0).cast("bigint")))

        def draw(a: Column, h: Column) -> Column:
            u = _uniform(F.lit(seed), F.col("node"), F.lit(level), h["place"])  # noqa: B023  called at once
            x = _hypergeometric(a["rest"], h["units"], a["left"], u)
            # What is left must fit in the sources that are left.
            x = F.least(F.greatest(x, a["left"] + h["units"] - a["rest"]), h["units"], a["left"])

            def keep(x: Column) -> Column:
                both = F.struct(h["place"].alias("place"), x.alias("one"), (h["units"] - x).alias("two"))
                rest, left = (a["rest"] - h["units"]).alias("rest"), (a["left"] - x).alias("left")
                return F.struct(rest, left, F.concat(a["out"], F.array(both)).alias("out"))

            return _let(x, keep)

        none = F.expr("cast(array() as array<struct<place:bigint,one:bigint,two:bigint>>)")
        start = F.struct(all_units.alias("rest"), F.col("goes").alias("left"), none.alias("out"))
        halves = nodes.select("group", "node", F.aggregate("held", start, draw, lambda a: a["out"]).alias("halves"))

        def half(name: str) -> Column:
            kept = F.filter("halves", lambda h: h[name] > 0)
            return F.transform(kept, lambda h: F.struct(h["place"].alias("place"), h[name].alias("units")))

        pair = F.array(
            F.struct((F.col("node") * 2).alias("node"), half("one").alias("held")),
            F.struct((F.col("node") * 2 + 1).alias("node"), half("two").alias("held")),
        )
        nodes = halves.select("group", F.explode(pair).alias("n")).select("group", "n.node", "n.held")
        if outer is not None:
            nodes = write_out(nodes.where(F.size("held") > 0), "split")
        elif level % 4 == 3:
            nodes = nodes.repartition("node")
    return nodes.select(F.col("node").alias("shard"), F.explode("held").alias("h")).select(
        "shard", F.col("h.place").alias("place"), F.col("h.units").alias("quota")
    )


def _told_apart(sized: DataFrame) -> DataFrame:
    """Rows that repeat an id and a text share a draw; all but the first get one of their own, so
    that they are dealt like any other rows. Which of them gets which makes no difference."""
    repeats = write_out(sized.groupBy("draw").agg(F.count("*").alias("n")).where("n > 1").select("draw"), "repeats")
    if repeats.isEmpty():
        return sized
    again = write_out(sized.join(repeats, "draw", "left_semi"), "again")
    ranked = rank_rows(again, ["draw"], ["size"], "rank", again.count())
    other = F.when(F.col("rank") > 1, F.xxhash64("draw", "rank")).otherwise(F.col("draw"))
    return write_out(sized.join(repeats, "draw", "left_anti").unionByName(ranked.withColumn("draw", other).select(sized.columns)), "apart")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), limit: int = 3, block_docs: int = 64, shard_words: int = 1_000_000, seed: int = 20, draw_col: str | None = None) -> DataFrame:
    """(id, source, size, source_size, target, taken, shards, draw), a row for each row of ``docs``.

    ``shards`` has one entry for each time that the mix takes the document, so ``taken`` is
    its length times ``size``. All draws hash the text with ``draw_col`` (the id by default). A source's taken words miss its target by at most half of
    one document. Null and empty texts have size 0 and take no words; a null source is a
    source of its own, the last. Repeated rows are documents of their own. An empty table
    gives an empty result. Other columns of ``docs`` are not read.
    """
    text = F.col(text_col).cast("string")
    sized = write_out(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"),
            F.xxhash64(F.lit(seed), F.col(draw_col or id_col), text).alias("draw"),
        ),
        "sized",
    )
    sized = _told_apart(sized)
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    sources = source_targets(by_source, weights, limit)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = write_out(
        sources.select(
            key.alias("key"), "place", "source_size", "target", F.ceil(F.col("docs") / block_docs).alias("blocks"),
            F.least(F.floor(share), F.lit(limit)).cast("int").alias("whole"),
        ).withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))),
        "targets",
    )
    placed = write_out(
        sized.withColumn("key", key).join(sources.select("key", "place", "blocks"), "key")
        .select("id", "source", "size", "draw", "place", F.pmod("draw", "blocks").alias("block")),
        "placed",
    )
    blocks = placed.groupBy("place", "block").agg(F.sum("size").alias("words")).withColumn(
        "turn", F.xxhash64(F.lit(seed + 1), "place", "block")
    )
    blocks = write_out(blocks, "blocks")
    upto = running_total(blocks, ["place"], ["turn", "block"], "words", "upto", blocks.count())
    facts = sources.select("place", "source_size", "target", "whole", "rest")
    blocks = write_out(upto.join(facts, "place").withColumn("before", F.col("upto") - F.col("words")), "blocks")
    within = Window.partitionBy("place", "block").orderBy("draw", "size", "id").rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("before") + F.sum("size").over(within) - F.col("size")
    # In the partial pass, a document is taken if that brings the sum nearer to the target.
    partial = F.when((F.col("size") > 0) & (before + F.col("size") / 2 <= F.col("rest")), 1).otherwise(0)
    picked = placed.join(blocks, ["place", "block"]).withColumn("times", F.col("whole") + partial)

    touched = F.col("whole") + F.when(F.col("before") < F.col("rest"), 1).otherwise(0)
    units = blocks.where(touched > 0).select("place", "block", F.explode(F.sequence(F.lit(1), touched.cast("int"))).alias("turn"))
    units = write_out(units.withColumn("draw", F.xxhash64(F.lit(seed + 2), "place", "block", "turn")), "units")
    total = sources.agg(F.sum("target")).first()[0] or 0
    depth = max(0, math.ceil(math.log2(max(1, total / shard_words))))
    quotas = write_out(split_quotas(units.groupBy("place").agg(F.count("*").alias("units")), depth, seed), "quotas")
    ends = running_total(quotas, ["place"], ["shard"], "quota", "end", quotas.count())
    taken_by = ends.select("place", "shard", F.explode(F.sequence(F.col("end") - F.col("quota") + 1, F.col("end"))).alias("rank"))
    ranked = rank_rows(units, ["place"], ["draw", "block", "turn"], "rank", units.count())
    shards = ranked.join(taken_by, ["place", "rank"]).groupBy("place", "block").agg(
        F.sort_array(F.collect_list(F.struct("turn", F.col("shard").cast("int").alias("shard")))).alias("units")
    )
    given = F.coalesce(F.slice(F.transform("units", lambda x: x["shard"]), F.lit(1), F.col("times")), F.array().cast("array<int>"))
    return picked.join(shards, ["place", "block"], "left").select(
        "id", "source", "size", "source_size", "target", (F.col("times") * F.col("size")).cast("bigint").alias("taken"),
        given.alias("shards"), "draw",
    )


def arrange(mixed: DataFrame, seed: int = 20) -> DataFrame:
    """(shard, position, and the columns of ``mixed``), a row for each time a document is taken.

    Positions follow a hashed order inside each shard, which holds about ``shard_words`` words.
    """
    rows = mixed.select("*", F.posexplode("shards").alias("_turn", "shard")).drop("shards")
    order = [F.xxhash64(F.lit(seed + 3), "draw", "_turn"), F.col("draw"), F.col("_turn"), F.col("id")]
    position = F.row_number().over(Window.partitionBy("shard").orderBy(*order))
    return rows.withColumn("position", position).drop("_turn")
