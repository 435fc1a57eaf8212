"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations alone.

A source's weight is a schedule over training time t in [0, 1], linear between knots; its integral is the source's share
of the whole. Shares become targets; a target stops at ``MAX_REPEATS`` times its source's size and the excess goes to
the others by weight. A document's repeats lie one after another in its source's stream of words, ordered by a digest of
the document; where the source's cumulative demand, which is the integral of its schedule, reaches a repeat's middle,
there is its training position. Positions order the mix by range.

Sums along a source run over blocks of the digest order, and over parts of several blocks: a part's blocks meet in one
window and a source's parts in another, and each of the two has about the root of the number of blocks. A source that
holds a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_of

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEATS = 3
#: Rows that a block of the digest order holds on average, at most; the number of blocks is a power of 16.
BLOCK_ROWS = 256
#: (t, factor) knots of a schedule; a factor multiplies the weight of a source.
CONSTANT = ((0.0, 1.0), (1.0, 1.0))
#: The curriculum of query and pipeline: a third of the sources fades out, a third stays, a third comes in. Each has
#: the integral 1, so a source's share of the whole is its weight.
CURRICULUM = (((0.0, 1.75), (0.5, 1.0), (1.0, 0.25)), CONSTANT, ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)))


def area_of(schedule) -> float:
    return float(sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:])))


def _schedules(schedule) -> tuple:
    """One schedule for all sources, or a tuple of them that sources take by place in turn."""
    return schedule if isinstance(schedule[0][0], (tuple, list)) else (schedule,)


def _turn(place: Column, n: int) -> Column:
    return F.pmod(place, F.lit(n))


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), schedule=CONSTANT) -> DataFrame:
    """``sizes(key, source, source_size)`` with place, weight (the schedule's integral) and target.

    Water filling in closed form: with sources in ascending order of cap over weight, the capped ones are a prefix, and
    the level is what is left of the total over the weights left. One row a source: the table is as small as the list
    of sources. Sources of size 0 get 0.
    """
    everything = Window.partitionBy()
    order = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    areas = [area_of(x) for x in _schedules(schedule)]
    of_place = lambda values: F.element_at(F.array(*map(F.lit, values)), (_turn(F.col("place"), len(values)) + 1).cast("int"))
    weight = of_place(weights) * of_place(areas)
    cap = F.col("source_size").cast("double") * F.lit(float(MAX_REPEATS))
    t = sizes.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", weight).withColumn("cap", cap)
    rank = Window.partitionBy().orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    rest = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("capped", F.coalesce(F.sum("cap").over(rank), F.lit(0.0))).withColumn("spent", F.coalesce(F.sum("weight").over(rank), F.lit(0.0)))
    level = (F.sum(F.col("source_size").cast("double")).over(rest) - F.col("capped")) / (F.sum("weight").over(rest) - F.col("spent"))
    t = t.withColumn("level", level)
    # the level of the first source in this order that stays under its cap holds for all after it
    first = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("capped", "spent", "level"))).over(rest)
    t = t.withColumn("final", first["level"])
    return t.select("key", "source", "source_size", "place", "weight", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least("cap", F.coalesce(F.col("final") * F.col("weight"), F.col("cap")))).alias("target"))


def _inverse(share: Column, schedule) -> Column:
    """Time at which a schedule's integral reaches ``share`` of its whole: a root of a quadratic on one piece."""
    want, done, out = share * F.lit(area_of(schedule)), 0.0, []
    for (t0, f0), (t1, f1) in zip(schedule, schedule[1:]):
        piece, slope = (t1 - t0) * (f0 + f1) / 2, (f1 - f0) / (t1 - t0)
        need = want - F.lit(done)
        if slope:
            root = (F.sqrt(F.greatest(F.lit(0.0), F.lit(f0 * f0) + F.lit(2 * slope) * need)) - F.lit(f0)) / F.lit(slope)
        else:
            root = need / F.lit(f0 or 1.0)
        here = F.lit(float(t0)) + root
        out.append((done + piece, here))
        done += piece
    position = out[-1][1]
    for limit, here in reversed(out[:-1]):
        position = F.when(want <= F.lit(limit), here).otherwise(position)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), position))


def _position(share: Column, place: Column, schedule) -> Column:
    """Training time of ``share`` of a source's demand, by the source's own schedule."""
    parts = _schedules(schedule)
    out = _inverse(share, parts[-1])
    for i, part in enumerate(parts[:-1]):
        out = F.when(_turn(place, len(parts)) == i, _inverse(share, part)).otherwise(out)
    return out


def _keyed(docs: DataFrame, doc_id: str, text: str, source: str, *more) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(text_of(docs, text)).alias("size"), *more)
    # the digest order, and a key under which a null source equals itself
    rows = rows.withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return rows.withColumn("key", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null")))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0), schedule=CONSTANT, carry: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, taken, position; sorted by position.

    ``taken`` counts the words taken, repeats included: each document is taken as often as the whole part of target over
    source size says, and the rest of the target goes to documents in digest order, the last one in part, so that a
    source's taken words are its target without the fraction. ``position`` is in [0, 1], null where nothing is taken.
    Null and empty texts have size 0 and are taken 0. A null source is a source. Rows with a null or a repeated doc_id
    are ordered by their sizes. ``schedule`` is one for all sources, or a tuple of schedules that sources take in turn
    by their place in code-point order, so that the mix changes over training time. An empty table gives an empty result.
    With ``carry`` a column ``row`` holds the whole row of ``docs``, whatever its columns are called.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    light = scratch.save(_keyed(docs, doc_id, text, source).select("doc_id", "source", "size", "order", "key"), "sizes")
    digits = max(1, math.ceil(math.log(max(1, light.count()) / BLOCK_ROWS, 16)))
    block = F.substring("order", 1, min(digits, 32))
    sums = scratch.save(light.groupBy("key", "source", block.alias("block")).agg(F.sum("size").alias("words")), "blocks")
    targets = source_targets(sums.groupBy("key", "source").agg(F.sum("words").alias("source_size")), weights, schedule)
    earlier = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda *keys: F.coalesce(F.sum("words").over(earlier(*keys)), F.lit(0))
    sums = sums.withColumn("part", F.substring("block", 1, max(1, digits // 2)))
    parts = sums.groupBy("key", "part").agg(F.sum("words").alias("words")).select("key", "part", ahead("key", "part").alias("before"))
    sums = sums.select("key", "part", "block", ahead("key", "part", "block").alias("inside")).join(parts, ["key", "part"])
    sums = sums.select("key", "block", (F.col("before") + F.col("inside")).alias("ahead")).join(targets.drop("source"), "key")
    sums = scratch.save(sums.select("key", "block", "ahead", "source_size", "place", "target"), "demand")

    rows = _keyed(docs, doc_id, text, source, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")) if carry else light
    dealt = rows.withColumn("block", block).join(sums, ["key", "block"])
    inside = Window.partitionBy("key", "block").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    turns = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    dealt = dealt.withColumn("start", start).withColumn("turns", turns)
    over = F.floor(F.col("target") - F.col("turns") * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), over - F.col("start")))
    dealt = dealt.withColumn("taken", (F.col("turns") * F.col("size") + part).cast("long"))
    share = (F.col("turns") * F.col("start") + F.least(F.col("start"), over) + F.col("taken") / 2) / F.greatest(F.col("target"), F.lit(1.0))
    position = F.when(F.col("taken") > 0, _position(F.least(F.lit(1.0), share), F.col("place"), schedule))
    out = dealt.select("doc_id", "source", "size", "source_size", "target", "taken", position.alias("position"), *(["row"] if carry else []))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as it is taken, a part counting as a whole,
    in ascending order of position. Documents of which nothing is taken, empty ones among them, are left out."""
    taken = mix(docs, carry=True, **options).where("taken > 0")
    copies = taken.select("row", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))).alias("_copy"))
    return copies.select("row.*")
