"""Mixing sources to target weights by Pfair scheduling, in built-in expressions only.

A source's documents are cut into blocks. Block j of a source with weight w may be scheduled from slot floor(j / w) on
and has to be by slot ceil((j + 1) / w); in every slot the released block with the earliest deadline goes first. Weights
are taken as given, so nothing repeats: stretches of slots are worked out apart, over the sources alone, and every block
finds its slot by a join with that table. At any slot each source has had its weight's share of slots to within less
than one block, however long the schedule. Only weights below 1 / (10 PERIOD) (with more than 5 PERIOD sources, below half
of an equal share) are lifted to that, and all scaled to a sum of 1.

Documents are numbered inside (source, bucket) pairs, whose counts are summed up per source, so no window holds a whole
source. The order inside a source is a hash order, which does not depend on the partitions.

When a source runs out, its slots stay empty and the others go on in their proportions; no document is dropped.

Defined results: a null source is a source of its own (the empty name is another); null texts and ids are kept; repeated
rows are documents of their own, ties in the hash order are ordered by id and digest of the text; sources without a
target weight get the least weight of the others; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceworks.llm.common import boxed, shuffle_width

#: Slots of one stretch at least, and documents of one block.
PERIOD, BLOCK = 1000, 16
#: A release or deadline so close to a whole slot is taken as that slot, since quotients are rounded.
NEAR = 1e-6


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _fractions(s: Column, period: int) -> Column:
    """Structs (source, w) of structs (source, weight): exact fractions of 1 that are 1 / _longest or more before scaling."""
    least = F.coalesce(F.array_min(F.filter(F.transform(s, lambda x: x["weight"]), lambda v: v > 0)), F.lit(1.0))

    def scaled(parts: Column) -> Column:
        return let(F.aggregate(parts, F.lit(0.0), lambda t, x: t + x["w"]), lambda total: F.transform(
            parts, lambda x: F.struct(x["source"].alias("source"), (x["w"] / total).alias("w"))))

    def lifted(parts: Column) -> Column:
        return F.transform(parts, lambda x: F.struct(
            x["source"].alias("source"), F.greatest(x["w"], 1 / _longest(parts, period)).alias("w")))

    given = let(least, lambda v: F.transform(s, lambda x: F.struct(
        x["source"].alias("source"), F.when(x["weight"] > 0, x["weight"]).otherwise(v).alias("w"))))
    return let(let(let(given, scaled), lifted), scaled)


def _longest(parts: Column, period: int) -> Column:
    """The slots in which every source gets one at least."""
    return F.greatest(F.lit(10 * period), 2 * F.size(parts)).cast("double")


def shares(weights: DataFrame, period: int = PERIOD) -> DataFrame:
    """(source, period, share): slots per period as an exact fraction, ``period`` in all."""
    one = weights.groupBy().agg(F.sort_array(F.collect_list(F.struct("source", "weight"))).alias("s"))
    return one.select(F.explode(_fractions(F.col("s"), period)).alias("x")).select(
        "x.source", F.lit(period).cast("long").alias("period"), (F.col("x.w") * period).alias("share"))


def slot_table(weights: DataFrame, period: int = PERIOD) -> DataFrame:
    """(source, nth, slot): the slot of every source's nth block, for ``weights`` (source, weight, blocks).

    Stretches of slots are worked out apart. Two earliest-deadline schedules that start from different blocks agree as
    soon as the blocks they differ in are past their deadlines, so a stretch begins one stretch earlier, which is twice
    the longest window, and gives only its own slots.
    """
    one = weights.groupBy().agg(F.sort_array(F.collect_list(F.struct("source", "weight", "blocks"))).alias("given"))
    one = one.where(F.size("given") > 0).withColumn("s", _fractions(F.col("given"), period))
    one = one.withColumn("length", F.greatest(F.lit(period), F.ceil(
        2 / F.array_min(F.transform("s", lambda x: x["w"]))).cast("long")).cast("long"))
    last = F.array_max(F.zip_with("s", "given", lambda x, g: F.ceil(g["blocks"] / x["w"])))
    # Dealt out before they are worked out.
    stretches = one.select("s", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / F.col("length")))).alias(
        "stretch")).repartition(shuffle_width(weights.sparkSession), "stretch").withColumn(
        "own", F.col("stretch") * F.col("length")).withColumn(
        "begin", F.greatest(F.col("own") - F.col("length"), F.lit(0).cast("long")))

    def release(done: Column, x: Column) -> Column:
        return F.floor(done / x["w"] + NEAR)

    def deadline(done: Column, x: Column) -> Column:
        return F.ceil((done + 1) / x["w"] - NEAR)

    # At the beginning: the blocks that are due by then, and of those released the ones with the earliest deadlines.
    due = F.transform("s", lambda x: F.floor(F.col("begin") * x["w"] + NEAR))
    stretches = stretches.withColumn("due", due)
    open_blocks = F.array_sort(F.filter(F.transform("s", lambda x, i: F.when(
        release(F.get("due", i), x) < F.col("begin"), F.struct(deadline(F.get("due", i), x).alias("deadline"), i.alias("i")))),
        lambda e: e.isNotNull()))
    more = F.greatest(F.col("begin") - F.aggregate("due", F.lit(0).cast("long"), lambda t, n: t + n), F.lit(0)).cast("int")
    stretches = stretches.withColumn("early", F.transform(F.slice(open_blocks, 1, more), lambda e: e["i"]))

    def step(state: Column, slot: Column) -> Column:
        # Open per source: its next block, if released by now, with its deadline.
        def candidate(x: Column, i: Column) -> Column:
            done = F.get(state["done"], i)
            return F.when(release(done, x) <= slot, F.struct(deadline(done, x).alias("deadline"), i.alias("i")))

        first = F.array_min(F.filter(F.transform(F.col("s"), candidate), lambda x: x.isNotNull()))
        return let(first, lambda f: F.struct(
            F.transform(state["done"], lambda n, i: n + F.when(i == f["i"], 1).otherwise(0)).alias("done"),
            F.when((slot < F.col("own")) | f.isNull(), state["order"]).otherwise(F.concat(state["order"], F.array(F.struct(
                f["i"].alias("i"), F.get(state["done"], f["i"]).alias("nth"), slot.alias("slot"))))).alias("order")))

    start = F.struct(F.transform("due", lambda n, i: n + F.when(F.array_contains("early", i), 1).otherwise(0)).alias("done"),
                     F.array().cast("array<struct<i:int,nth:bigint,slot:bigint>>").alias("order"))
    planned = F.aggregate(F.sequence(F.col("begin"), F.col("own") + F.col("length") - 1), start, step)
    return stretches.select("s", F.explode(planned["order"]).alias("o")).select(
        F.get("s", F.col("o.i"))["source"].alias("source"), F.col("o.nth").alias("nth"), F.col("o.slot").alias("slot"))


def numbered(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``rows`` (with source, key1, key2) with ``block`` and ``place``: its block in the source and place in the block."""
    buckets = 4 * shuffle_width(rows.sparkSession)
    rows = rows.withColumn("order", F.xxhash64("key1", "key2")).withColumn(
        "bucket", F.shiftrightunsigned(F.col("order"), 33) % F.lit(buckets))
    counts = rows.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("source", "bucket").orderBy("order", "key1", "key2")
    r = rows.withColumn("nth", F.row_number().over(inside) - 1).alias("r")
    c = counts.alias("c")
    joined = r.join(c, F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.bucket") == F.col("c.bucket")))
    at = F.col("c.before") + F.col("r.nth")
    return joined.select("r.*", F.floor(at / block).alias("block"), (at % block).alias("place")).drop(
        "order", "bucket", "nth")


def schedule(docs: DataFrame, weights: DataFrame | None = None, source_col: str = "source", id_col: str = "doc_id",
             text_col: str = "text", block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """(doc_id, tag, source, block, place, slot): the slot of every document's block and its place in the block.

    Ordering by slot and place gives the mix; ``tag`` is a digest of the text. ``weights`` has (source, weight); by
    default the tempered shares of the table itself.
    """
    rows = docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).cast("long").alias("key1"),
                       F.hash(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("key2"))
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.sqrt(F.col("n").cast("double"))
    else:
        weights = weights.select(F.col("source").alias("of"), F.col("weight").cast("double").alias("weight"))
        counts = counts.join(weights, F.col("source").eqNullSafe(F.col("of")), "left")
        weight = F.coalesce("weight", F.lit(0.0))
    slots = slot_table(counts.select("source", weight.alias("weight"), F.ceil(F.col("n") / block).alias("blocks")),
                       period).alias("s")
    n = numbered(rows, block).alias("n")
    return n.join(slots, F.col("n.source").eqNullSafe(F.col("s.source")) & (F.col("n.block") == F.col("s.nth"))).select(
        F.col("n.key1").alias("doc_id"), F.col("n.key2").alias("tag"), "n.source", "n.block", "n.place", "s.slot")


def in_mixed_order(docs: DataFrame, weights: DataFrame | None = None, source_col: str = "source",
                   id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """The rows of ``docs``, all of them, dealt out and sorted by slot, so that files follow the mix one by one.

    Repeated rows take the earliest of their slots.
    """
    slots = schedule(docs, weights, source_col, id_col, text_col, block, period).groupBy("doc_id", "tag").agg(
        F.min(F.struct("slot", "place")).alias("at"))
    rows = boxed(docs, id_col, text_col).select("doc_id", "tag", "row")
    joined = rows.join(slots, rows["doc_id"].eqNullSafe(slots["doc_id"]) & (rows["tag"] == slots["tag"])).select(
        "at.slot", "at.place", "row")
    return joined.repartitionByRange(shuffle_width(docs.sparkSession), "slot", "place").sortWithinPartitions(
        "slot", "place").select("row.*")
