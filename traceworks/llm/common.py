"""What several operators need: keyed texts, written intermediate tables, clash-free joins back to rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceworks.session import checkpoint_dir

#: ASCII white space, as a pattern for built-in expressions.
SPACES = "[\\x20\\x09-\\x0D]"


#: The list that a caller of ``recorded`` collects written folders in.
_record: ContextVar[list[str] | None] = ContextVar("record", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, every executor can reread it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (record := _record.get()) is not None:
        record.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders that ``written`` makes inside the block."""
    paths: list[str] = []
    token = _record.set(paths)
    try:
        yield paths
    finally:
        _record.reset(token)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder made by ``written``, if it is still there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_written(df: DataFrame) -> None:
    """Delete a table made by ``written`` once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_folder(df.sparkSession, folder)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tag, text): the id as given, a short digest of the text, the text with null as empty.

    Rows that agree in id and text are one document; rows that share only the id stay apart by the tag.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.hash(text).alias("tag"), text.alias("text"))


def own_key() -> Column:
    """One number for a document of ``keyed``: a 64-bit hash of id and tag."""
    return F.xxhash64("doc_id", "tag")


def with_list(docs: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """``docs`` with the column ``name``: the list of other columns of ``rows`` that have its doc_id and tag, or null.

    ``rows`` have doc_id and tag, or their ``own_key`` as ``own``. One other column gives a list of its values, several
    a list of structs, with the tag if given. Rows that share only an id, a null one too, are documents of their own.
    Every such join deals the texts out by the same key, so one exchange of them serves several joins of a plan.
    """
    columns = [c for c in rows.columns if c not in ("doc_id", "tag", "own")]
    if "own" not in rows.columns:
        rows = rows.withColumn("own", own_key())
    item = F.struct(*(["tag"] if "tag" in rows.columns else []), *columns) if len(columns) > 1 else F.col(columns[0])
    lists = rows.select("own", item.alias("item")).groupBy("own").agg(F.collect_list("item").alias(name))
    return docs.withColumn("own", own_key()).join(lists, "own", "left").drop("own")


def boxed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``keyed`` with ``row``: all given columns kept aside, so that no name can clash."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.hash(text).alias("tag"), text.alias("text"),
                       row.alias("row"))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
