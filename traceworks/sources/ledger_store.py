"""The append-only ledger as files: event days, id buckets inside them, and a stored id filter per bucket.

An append has to know which ids are stored already, whatever day they were stored under. Every append leaves, per
(day, bucket), bitmaps that its ids set bits in (a Bloom filter, built by Spark's bitmap aggregate). The next append
probes them with its own ids and opens only the buckets whose filters answer, reading nothing but their ids.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceworks.operators.dedup import keep_first

#: Id buckets inside a day, bitmaps per bucket, and bits set by an id in its bitmap. Fixed for the life of a ledger.
BUCKETS, PIECES, HASHES = 4, 16, 5
POSITIONS = [f"p{j}" for j in range(HASHES)]
#: Bits of one bitmap of the built-in aggregate.
BITS = 32_768
CELL = ["event_date", "id_bucket"]


def exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def _words(bits: Column) -> Column:
    """The 64-bit words of a bitmap, the first byte of a word as its highest."""
    return F.transform(F.sequence(F.lit(0), F.lit(BITS // 64 - 1)), lambda k: F.conv(
        F.hex(F.substring(bits, k * 8 + 1, F.lit(8))), 16, -10).cast("long"))


def _bit(words: Column, position: Column) -> Column:
    """Whether a bit is set in the words of a bitmap; cheap, as it runs for every id and day."""
    at = F.lit(56) - F.shiftright(position, 3).bitwiseAND(F.lit(7)) * 8 + position.bitwiseAND(F.lit(7))
    return F.getbit(F.get(words, F.shiftright(position, 6)), at) == 1


def _is_set(bits: Column, position: Column) -> Column:
    """Whether a bit of a bitmap is set."""
    return _bit(_words(bits), position)


class ParquetLedger:
    """Append-only ledger; the first write of a trace id wins and later ones are dropped.

    One writer at a time. A failed append that is run again finds its own rows; filters are written before the rows, so
    that a failure in between leaves ids that are looked for in vain, never ids that are not found.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, pieces: int = PIECES):
        self.spark, self.path, self.buckets, self.pieces = spark, path.rstrip("/"), buckets, pieces
        self.filters = f"{self.path}/_ids/{buckets}x{pieces}"

    def read(self) -> DataFrame | None:
        """All rows with their ``event_date``, or None before the first append."""
        if not exists(self.spark, self.path):
            return None
        return self.spark.read.option("mergeSchema", True).parquet(self.path).drop("id_bucket")

    def placed(self, events: DataFrame) -> DataFrame:
        """Rows with the day and the bucket they belong to."""
        return events.withColumns({
            "event_date": F.coalesce(F.left("event_timestamp", F.lit(10)), F.lit("unknown")),
            "id_bucket": F.pmod(F.xxhash64("trace_id"), F.lit(self.buckets)).cast("int")})

    def _probes(self, events: DataFrame) -> DataFrame:
        """(cell, piece, p0, p1, ..): where the ids' bits stand."""
        positions = [F.pmod(F.xxhash64("trace_id", F.lit(j)), F.lit(BITS)).cast("int").alias(p) for j, p in enumerate(POSITIONS)]
        return self.placed(events).where(F.col("trace_id").isNotNull()).select(
            *CELL, F.pmod(F.shiftright(F.xxhash64("trace_id"), 20), F.lit(self.pieces)).cast("int").alias("piece"), *positions)

    def _stored_filters(self) -> DataFrame:
        return self.spark.read.schema("event_date string, piece int, bits binary, id_bucket int").parquet(self.filters)

    def store_filters(self, events: DataFrame) -> None:
        """Set the bits of all ids; those that turn out to be stored before only add to the false answers."""
        # One row per id is sorted, not one per bit.
        each = self._probes(events).groupBy(*CELL, "piece").agg(*[F.bitmap_construct_agg(p).alias(p) for p in POSITIONS])
        bits = each.select(*CELL, "piece", F.explode(F.array(*POSITIONS)).alias("bits")).groupBy(*CELL, "piece").agg(
            F.bitmap_or_agg("bits").alias("bits"))
        bits.repartition("id_bucket").write.mode("append").partitionBy("id_bucket").parquet(self.filters)

    def merge_filters(self) -> None:
        """One bitmap per cell and piece instead of one per append; to be run now and then, while nothing is appended."""
        merged = self._stored_filters().groupBy(*CELL, "piece").agg(F.bitmap_or_agg("bits").alias("bits"))
        replace_folder(self.spark, merged.repartition("id_bucket"), self.filters, ["id_bucket"])

    def cells_hit(self, events: DataFrame) -> list[tuple[str, int]]:
        """The (day, bucket) cells that may hold one of the ids: at most the number of the ledger's own folders."""
        filters = self._stored_filters().withColumn("words", _words(F.col("bits"))).drop("bits")
        probes = self._probes(events).drop("event_date")
        set_in = functools.reduce(Column.__and__, [_bit(F.col("words"), F.col(p)) for p in POSITIONS])
        answers = probes.join(filters, ["id_bucket", "piece"]).where(set_in)
        return sorted((r.event_date, r.id_bucket) for r in answers.select(*CELL).distinct().collect())

    def stored_ids(self, events: DataFrame) -> DataFrame | None:
        """The ids in the cells that may hold one of ``events``; None where no cell does."""
        cells = []
        if exists(self.spark, self.filters):
            cells = self.cells_hit(events)
        elif exists(self.spark, self.path):
            raise ValueError("the ledger was written with other numbers of buckets or bitmaps")
        if not cells:
            return None
        ids = self.spark.read.schema("trace_id string, event_date string, id_bucket int").parquet(self.path)
        days, buckets = ({c[k] for c in cells} for k in (0, 1))
        return ids.where(F.col("event_date").isin(sorted(days)) & F.col("id_bucket").isin(sorted(buckets))).select("trace_id")

    def append(self, events: DataFrame) -> None:
        order = ["ingest_seq"] if "ingest_seq" in events.columns else ["event_timestamp"]
        stored = self.stored_ids(events)
        self.store_filters(events)
        fresh = self.placed(keep_first(events, ["trace_id"], order))
        if stored is not None:
            fresh = fresh.join(stored, "trace_id", "left_anti")
        # Few files per cell; a cell that holds much of the data is split by size.
        fresh.hint("rebalance", *[F.col(c) for c in CELL]).write.mode("append").partitionBy(*CELL).parquet(self.path)


def replace_folder(spark: SparkSession, df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Write beside a folder, then take its place; a failure before that leaves the old one."""
    fresh, old = f"{path}-next", f"{path}-old"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(fresh)
    jvm = spark._jvm
    at, beside, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, fresh, old))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(aside, True)
    fs.rename(at, aside)
    fs.rename(beside, at)
    fs.delete(aside, True)
