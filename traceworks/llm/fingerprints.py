"""Threshold-scaled sketches of documents, in built-in expressions only.

A fingerprint keeps every shingle hash below a fixed share of the hash range, so fingerprints of parts merge by union,
and the overlap of two fingerprints estimates how much of the smaller text the larger one contains, however unequal
their sizes. It is a text: the kept hashes as sorted hex numbers of fixed width.

Defined results: words are runs without ASCII white space; a text with fewer words than a shingle has its whole word
sequence as one shingle; null text is empty, and an empty text has an empty fingerprint. Likeness is the shared part
of the smaller fingerprint; two empty fingerprints are alike (1) if the texts are equal and unlike (0) otherwise.
Equal texts have equal fingerprints. Rows are taken one by one, repeated rows too; an empty table gives an empty
result. Columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceworks.llm.common import SPACES, shuffle_width

#: Shingle width in words, and the share of the hash range that is kept, as one part in ``SCALE``.
SHINGLE, SCALE = 5, 4


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def threshold(scale: int) -> Column:
    """The hash below which one part in ``scale`` of all hashes lies."""
    return F.lit(-(1 << 63) + (1 << 64) // scale)


def kept_hashes(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """Sorted distinct shingle hashes below the threshold."""
    below = threshold(scale)

    def hashes(w: Column) -> Column:
        last = F.greatest(F.size(w) - (shingle - 1), F.lit(1))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(w, i, shingle))))

    found = let(F.filter(F.split(text, SPACES + "+"), lambda x: x != ""), hashes)
    return F.sort_array(F.array_distinct(F.filter(found, lambda h: h < below)))


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def likeness(a: Column, b: Column, equal: Column) -> Column:
    """Shared part of the smaller of two kept-hash lists; ``equal`` says whether the texts are equal."""
    least = F.least(F.size(a), F.size(b))
    return F.when(equal, F.lit(1.0)).when(least == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / least).cast("double")


def coarser(hashes: Column, scale: int) -> Column:
    """The fingerprint at a larger ``scale``: that of the same text if it had been made at it."""
    return F.filter(hashes, lambda h: h < threshold(scale))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too, from their kept hashes; null if ``a`` keeps none.

    ``b`` may be made at any scale that is not larger than that of ``a``, however unequal the texts; the standard error is that
    of a share among ``size(a)`` draws.
    """
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).cast("double")


def merged(sketches: DataFrame, *by: str, scale: int = SCALE) -> DataFrame:
    """(by, hashes, fingerprint): the fingerprint of all shingles of a group, from its rows' ``hashes``.

    Merging in several steps or in another order gives the same. Null keys are a group; a group without hashes has an
    empty fingerprint. Equal hashes are dropped before and after the exchange on (group, hash), so a hot group is many
    tasks' work; its fingerprint is one row, of one part in ``scale`` of its distinct shingles: take a larger one than that
    of the rows for groups of very many documents.
    """
    rows = sketches.select(*by, F.explode_outer(coarser(F.col("hashes"), scale)).alias("hash")).distinct()
    return rows.groupBy(*by).agg(F.sort_array(F.collect_list("hash")).alias("hashes")).withColumn(
        "fingerprint", as_text(F.col("hashes")))


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``next_text``: that of the next document in descending id, the first after the last.

    Ids are cut into ranges at quantiles; rows are ordered inside a range, and a range's last row takes the first row
    of the next range that is not empty. Rows without id come last; ties are ordered by text.
    """
    spark = docs.sparkSession
    ranges = 4 * shuffle_width(spark)
    cuts = docs.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 100 * ranges)).first()[0]
    cuts = F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts or []))]).cast("array<bigint>")
    part = F.coalesce(F.size(F.filter(cuts, lambda c: c < F.col("doc_id"))), F.lit(-1))
    docs = docs.withColumn("part", F.when(F.col("doc_id").isNull(), -1).otherwise(part))
    order = Window.partitionBy("part").orderBy(F.col("doc_id").desc(), "text")
    rows = docs.withColumn("within", F.lead("text").over(order)).withColumn(
        "last", F.lead(F.lit(1)).over(order).isNull()).withColumn("nth", F.row_number().over(order))
    # The range that reads each range's first row: bounded by the number of ranges.
    readers = docs.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(
        F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("reader"))
    head = rows.where("nth = 1").select("part", F.col("text").alias("head")).join(readers, "part").select("reader", "head")
    return rows.join(head, F.col("last") & (rows["part"] == head["reader"]), "left").select(
        "doc_id", "text", F.when(F.col("last"), F.col("head")).otherwise(F.col("within")).alias("next_text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hashes, fingerprint) per row."""
    hashes = kept_hashes(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), hashes.alias("hashes")).withColumn(
        "fingerprint", as_text(F.col("hashes")))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and the likeness of text to edited form and to next text.

    The edit replaces the last third of the code points by the first as many (or all) of the next document.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = F.length("text")
    third = F.floor(size / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - third), F.substring("next_text", F.lit(1), third))
    rows = with_next(docs).withColumn("edited", edited)
    same_edit, same_next = F.col("text") == F.col("edited"), F.col("text") == F.col("next_text")
    packed = F.struct(kept_hashes(F.col("text")).alias("own"), kept_hashes(F.col("edited")).alias("edited"),
                      kept_hashes(F.col("next_text")).alias("next"))

    def result(h: Column) -> Column:
        return F.struct(as_text(h["own"]).alias("fingerprint"), as_text(h["edited"]).alias("edited_fingerprint"),
                        likeness(h["own"], h["edited"], same_edit).alias("near_edited"),
                        likeness(h["own"], h["next"], same_next).alias("near_next"))

    return rows.select("doc_id", size.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       let(packed, result).alias("r")).select("doc_id", "n_chars", "edited_sha256", "r.*")
