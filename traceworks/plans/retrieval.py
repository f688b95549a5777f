"""Knowledge-base ingest, search results, context and prompt rows."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceworks.operators.knn import nearest_neighbours
from traceworks.sources.file_table import FileTable

# Collection per file extension, and context size.
COLLECTION_OF = {".pdf": "pdfs", ".png": "images", ".jpg": "images", ".jpeg": "images",
                 ".txt": "documents", ".md": "documents", ".csv": "documents"}
MAX_CONTEXT_CHARS = 6000
NO_TEXT = "(No extracted text)"
RULE = "─" * 60
SYSTEM_TEXT = ("Answer from the passages below and from nothing else. Where they do not say, answer that they do not. "
               "Keep it short and exact.")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def collection_of(path: Column) -> Column:
    pairs = [F.lit(x) for kv in COLLECTION_OF.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def image_caption(name: Column, uri: Column) -> Column:
    return F.concat(F.lit("Image file "), name, F.lit(" stored at "), uri)


def hash_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """Deterministic stand-in for an embedding model: hashed word counts, unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(dim, dtype=np.float64)
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode())
                v[h % dim] += 1.0 if (h >> 16) & 1 else -1.0
            norm = np.sqrt((v ** 2).sum())
            out.append((v / norm if norm else v).astype(np.float32).tolist())
        return out

    return embed


def embedded(text: Column, embed: Callable[[list[str]], list[list[float]]]) -> Column:
    """Vectors of a text column, a batch of rows per model call."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(embed(texts.tolist()))

    return run(text)


def ingest_records(files: DataFrame, embed: Callable) -> DataFrame:
    """Records (collection, filename, source_uri, text, vector) of readable files.

    Images get a caption; files of unknown type and empty text files are left out.
    """
    routed = files.withColumn("collection", collection_of(F.col("filename"))).where(F.col("collection").isNotNull())
    text = F.when(F.col("collection") == "images", image_caption(F.col("filename"), F.col("source_uri"))).when(
        (F.col("collection") == "pdfs") & (F.trim(F.coalesce("text", F.lit(""))) == ""),
        F.concat(F.lit("PDF file "), F.col("filename"), F.lit(" stored at "), F.col("source_uri"),
                 F.lit(". No readable text extracted; likely a purely image-based or unsupported document.")),
    ).otherwise(F.col("text"))
    records = routed.withColumn("text", text).where(F.trim("text") != "")
    return records.withColumn("vector", embedded(F.col("text"), embed))


def search(kb: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k nearest records per query with their source fields."""
    hits = nearest_neighbours(kb, queries, k)
    about = kb.select("collection", "doc_id", "filename", "source_uri", "text")
    return hits.join(about, ["collection", "doc_id"])


def snippet() -> Column:
    body = F.trim(F.coalesce("text", F.lit("")))
    return F.concat(
        F.lit("["), F.col("collection"), F.lit("] "), F.col("filename"), F.lit(" - "), F.col("source_uri"),
        F.lit("\n"), F.when(body == "", NO_TEXT).otherwise(body), F.lit("\n"))


def context_chunks(results: DataFrame, max_chars: int = MAX_CONTEXT_CHARS) -> DataFrame:
    """Result rows that fit the character budget in rank order, the last one cut.

    A query holds at most k results, so the running sum stays small.
    """
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    sized = results.withColumn("snippet", snippet()).withColumn(
        "left_over", F.lit(max_chars) - F.coalesce(F.sum(F.length("snippet")).over(before), F.lit(0)))
    fits = sized.where(F.col("left_over") > 0)
    return fits.select("query_id", "rank", F.left("snippet", F.col("left_over").cast("int")).alias("chunk"))


def context_text(chunks: DataFrame) -> DataFrame:
    """One context per query; at most k chunks each."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "chunk")))
    return chunks.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["chunk"]), "\n\n").alias("context"))


def augmented_question(context: Column, question: Column) -> Column:
    return F.concat(F.lit(f"Context from knowledge base:\n{RULE}\n"), context,
                    F.lit(f"\n{RULE}\n\nQuestion: "), question)


def prompt_rows(history: DataFrame, questions: DataFrame, system_text: str = SYSTEM_TEXT) -> DataFrame:
    """Prompt messages as rows (conv_id, position, role, content).

    One row per message: system text first, then the history by turn, then
    the question with its context. A conversation is never gathered, so its
    length does not matter. ``questions`` has conv_id, question and context.
    """
    system = questions.select("conv_id", F.lit(0).cast("bigint").alias("position"), F.lit("system").alias("role"),
                              F.lit(system_text).alias("content"))
    turns = history.select("conv_id", (F.col("turn") + 1).alias("position"), "role", F.col("text").alias("content"))
    last = history.groupBy("conv_id").agg((F.max("turn") + 2).alias("position"))
    asked = questions.join(last, "conv_id", "left").select(
        "conv_id", F.coalesce("position", F.lit(1)).alias("position"), F.lit("user").alias("role"),
        augmented_question(F.col("context"), F.col("question")).alias("content"))
    return system.unionByName(turns).unionByName(asked)


def catalog_listing(kb: DataFrame) -> DataFrame:
    return kb.select("collection", "filename", "source_uri")


def without_document(kb: DataFrame, filename: str) -> DataFrame:
    return kb.where(~F.col("filename").eqNullSafe(filename))


def collections_holding(kb: DataFrame, filename: str) -> DataFrame:
    return kb.where(F.col("filename") == filename).agg(
        F.count_distinct("collection").alias("collections_affected"))


def delete_document(stored: FileTable, filename: str) -> int:
    """Delete a document from every collection of a stored table; the number of collections that held it."""
    rows = stored.read()
    held = 0 if rows is None else collections_holding(rows, filename).first()[0]
    if held:
        stored.delete(F.col("filename") == filename)
    return held


def union_collections(collections: dict[str, DataFrame | None]) -> DataFrame:
    """Collections under each other with their name; missing ones are skipped."""
    out = None
    for name, df in collections.items():
        if df is None:
            continue
        tagged = df.withColumn("collection", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def model_texts(models: DataFrame, columns: DataFrame) -> DataFrame:
    """One search text per model: name, description and column names."""
    names = columns.groupBy("model_name").agg(F.array_join(F.sort_array(F.collect_list("column_name")), ", ").alias("cols"))
    return models.join(names, "model_name", "left").select(
        "model_name",
        F.concat(F.lit("Model: "), F.col("model_name"), F.lit("\nDescription: "), F.col("description"),
                 F.lit("\nColumns: "), F.coalesce("cols", F.lit(""))).alias("text"))


class MetadataIndex:
    """Vectors of model texts in a stored table; built anew only when the texts' content has changed.

    The table's newest version is the index in use. Its rows carry the content they were built from, so a build that
    stops half way leaves the version before.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.stored = FileTable(spark, path)

    @staticmethod
    def content_of(texts: DataFrame) -> str:
        """A hash of all rows (doc_id, text) in any order."""
        mark = F.xxhash64("doc_id", "text")
        n, total, mixed = texts.agg(F.count("*"), F.sum(mark.cast("decimal(38,0)")), F.bit_xor(mark)).first()
        return f"{n}:{total}:{mixed}"

    def refresh(self, texts: DataFrame, embed: Callable, content: str | None = None) -> bool:
        """Embed and store ``texts`` unless the index holds this content already; whether it was built.

        ``content`` may be the hash of the manifest the texts come from; by default the texts themselves are hashed.
        """
        content = self.content_of(texts) if content is None else content
        rows = self.read()
        held = rows.select("content").first() if rows is not None else None
        if held is not None and held[0] == content:
            return False
        self.stored.replace(texts.select("doc_id", "text", embedded(F.col("text"), embed).alias("vector"),
                                         F.lit(content).alias("content")))
        return True

    def read(self) -> DataFrame | None:
        return self.stored.read()

    def search(self, questions: DataFrame, k: int = 3) -> DataFrame:
        """The ``k`` nearest texts per question (query_id, query_vector)."""
        base = self.read().select("doc_id", F.lit("models").alias("collection"), "vector")
        return nearest_neighbours(base, questions, k)
