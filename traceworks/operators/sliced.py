"""Group-ordered windows that survive a group holding a third of all rows.

A plain window puts every row of a group into one task. Here groups beyond a
bound are cut into pieces of their order, of about equally many rows. A table
of the pieces (count, first and last time) is small, since only large groups
are in it and rows are counted before the shuffle; running sums over it give
each piece its place in the group. All other groups are ordinary windows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceworks.sources.sinks import scratch_path, write_counted

#: Rows up to which a group, or a piece of one, is ordered by one task, and how often a piece is cut again.
PIECE_ROWS = 100_000
LEVELS = 6


def _slice_of(ts: str, tiebreak: str, unit: str) -> Column:
    """Sortable slice of a row; rows without a time are sliced by the head of
    the tiebreak column, which sorts the same way as the column itself."""
    missing = F.col(ts).isNull()
    return F.struct(missing.alias("late"), F.date_trunc(unit, ts).alias("at"),
                    F.when(missing, F.substring(F.col(tiebreak), 1, 6)).alias("head"))


def ordered_texts(
    df: DataFrame,
    keys: list[str],
    ts: str,
    tiebreak: str,
    texts: dict[str, tuple[str, str, str]],
    slice_unit: str = "hour",
) -> DataFrame:
    """Per group, values joined in time order: ``texts`` maps a result name to
    (value column, condition, separator). Groups without any value are absent.

    Values are sorted and joined inside time slices first, in parallel; the
    last step only strings a group's slices together.
    """
    wanted = {n: F.col(v).isNotNull() & F.coalesce(F.expr(c), F.lit(False)) for n, (v, c, _) in texts.items()}
    any_wanted = reduce(lambda a, b: a | b, wanted.values())
    order = [F.col(ts).isNull(), F.col(ts), F.col(tiebreak)]

    def joined(items: Column, sep: str) -> Column:
        kept = F.sort_array(F.collect_list(items))
        return F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda x: x["v"]), sep))

    def item(value: str, cond: Column, place: list[Column]) -> Column:
        return F.when(cond, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(place)], F.col(value).alias("v")))

    slices = (
        df.where(any_wanted).groupBy(F.struct(*keys).alias("_g"), _slice_of(ts, tiebreak, slice_unit).alias("_s"))
        .agg(*[joined(item(v, wanted[n], order), sep).alias(n) for n, (v, _, sep) in texts.items()]))
    return slices.groupBy("_g").agg(*[
        joined(item(n, F.col(n).isNotNull(), [F.col("_s")]), sep).alias(n) for n, (_, _, sep) in texts.items()])


def with_texts(grouped: DataFrame, keys: list[str], texts: DataFrame, names: list[str]) -> DataFrame:
    """Grouped rows with their ordered texts, '' where a group has none."""
    joined = grouped.withColumn("_g", F.struct(*keys)).join(texts, "_g", "left").drop("_g")
    return joined.withColumns({n: F.coalesce(n, F.lit("")) for n in names})


def _split(rows: DataFrame, ts: str, tiebreak: str, bound: int) -> tuple[DataFrame, bool]:
    """``rows`` with their piece ``_k`` refined until no piece has more than ``bound`` rows, and whether any was.

    Only pieces beyond the bound are cut: into ranges of time, or of the tiebreak where all times are equal or missing.
    A range that turns out too full (a burst) is cut again. The tables of pieces to cut have at most one row in
    ``bound``; they are written, so that the planner knows their size when it joins them.
    """
    spark, cut = rows.sparkSession, False
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    for _ in range(LEVELS):
        # Counted by hash first; times and ids are looked at only in what is too large.
        path = scratch_path(spark, "large")
        if not write_counted(rows.groupBy("_k").agg(F.count("*").alias("_n")).where(F.col("_n") > bound), path):
            break
        sizes = (
            rows.join(spark.read.parquet(path).select("_k"), "_k", "left_semi").groupBy("_k").agg(
                F.count("*").alias("_n"), F.count(ts).alias("_timed"), F.min(micros).alias("_lo"),
                F.max(micros).alias("_hi"), F.min(tiebreak).alias("_lo_id"), F.max(tiebreak).alias("_hi_id"))
            .where((F.col("_lo") < F.col("_hi")) | (F.col("_lo_id") < F.col("_hi_id"))
                   | F.col("_timed").between(1, F.col("_n") - 1)))
        # All ids of a piece begin with what its lowest and highest id have in common.
        common = F.expr("size(filter(sequence(1, greatest(1, length(_lo_id))), k -> left(_lo_id, k) = left(_hi_id, k)))")
        sizes = sizes.withColumn("_common", F.coalesce(common, F.lit(0))).withColumns({
            "_by_id": F.coalesce(F.col("_lo") == F.col("_hi"), F.lit(True)) & (F.col("_timed").isin(0, F.col("_n"))),
            "_pieces": F.ceil(F.col("_n") * 4 / bound)})
        path = scratch_path(spark, "pieces")
        if not write_counted(sizes, path):
            break
        cut = True
        first, last = _id_number("_lo_id"), _id_number("_hi_id")
        at = F.when(F.col("_by_id"), _id_number(tiebreak) - first).otherwise(micros - F.col("_lo"))
        span = F.when(F.col("_by_id"), last - first).otherwise(F.col("_hi") - F.col("_lo")) + 1
        place = F.when(F.col("_n").isNotNull(), F.struct(
            F.col(ts).isNull().alias("late"),
            F.expr("_at div greatest(1L, cast(ceil(_span / _pieces) as bigint))").alias("range")))
        rows = (
            rows.join(spark.read.parquet(path), "_k", "left").withColumns({"_at": at, "_span": span})
            .withColumn("_k", F.struct("_k", place.alias("piece"))).drop(*sizes.columns[1:], "_at", "_span"))
    return rows, cut


def _id_number(name: str) -> Column:
    """The seven bytes after the common beginning of ids, which are strings, as a number; it ascends with the id."""
    return F.expr(f"cast(conv(rpad(left(hex(encode(substring({name}, _common + 1, 7), 'utf-8')), 14), 14, '0'), 16, 10) as bigint)")


def sequence_in_group(
    df: DataFrame,
    keys: list[str],
    ts: str,
    tiebreak: str,
    bound: int = PIECE_ROWS,
) -> DataFrame:
    """Add ``event_sequence`` (1..n by time, NULL times last), ``group_start``,
    ``group_end`` and ``prev_ts`` (time of the row before) to every row.

    A group of up to ``bound`` rows is one window. Larger ones are counted first and cut into pieces of their order,
    which windows number apart; rows equal in time and tiebreak stay in one piece. The count runs when the plan is made.
    """
    # Struct keys compare NULL fields as equal, so NULL groups keep their rows.
    rows, cut = _split(df.withColumn("_g", F.struct(*keys)).withColumn("_k", F.struct("_g")), ts, tiebreak, bound)
    ordered = Window.partitionBy(*(["_k"] if cut else keys)).orderBy(F.col(ts).asc_nulls_last(), F.col(tiebreak))
    # One order serves all: a frame of the whole piece needs no other sort.
    piece = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if cut:
        group = Window.partitionBy("_g")
        before = group.orderBy("_k")
        pieces = rows.groupBy("_g", "_k").agg(
            F.count("*").alias("n"), F.min(ts).alias("lo"), F.max(ts).alias("hi"))
        # Groups in one piece need no table: they are told by having no range at the first cut.
        whole = rows.schema["_k"].dataType
        depth = 0
        while "piece" in whole.names:
            whole, depth = whole["_k"].dataType, depth + 1
        pieces = pieces.where(F.col(".".join(["_k"] * depth) + ".piece").isNotNull()).select(
            "_k",
            F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
            F.lag("hi").over(before).alias("_prev_hi"),
            F.min("lo").over(group).alias("_start"),
            F.max("hi").over(group).alias("_end"))
        path = scratch_path(df.sparkSession, "offsets")
        pieces.write.parquet(path)
        rows = rows.join(df.sparkSession.read.parquet(path), "_k", "left")
    else:
        time = F.lit(None).cast(df.schema[ts].dataType)
        rows = df.withColumns({"_offset": F.lit(0), "_prev_hi": time, "_start": time, "_end": time})
    number = F.row_number().over(ordered)
    return rows.withColumns({
        "event_sequence": F.coalesce("_offset", F.lit(0)).cast("long") + number,
        "group_start": F.coalesce("_start", F.min(ts).over(piece)),
        "group_end": F.coalesce("_end", F.max(ts).over(piece)),
        "prev_ts": F.when(number == 1, F.col("_prev_hi")).otherwise(F.lag(ts).over(ordered)),
    }).drop("_g", "_k", "_offset", "_prev_hi", "_start", "_end")
