"""The corpus pipeline: documents in, piece sequences out, one operator per stage.

Each stage is written as Parquet and read again for the next. The order of the mixing stage is in its files: they hold
ascending ranges of slots, and each file's rows stand in the order of the mix. Readers take files in any order, so the
last stage turns a row's place in the files into the column ``position``: sorted by it, the result is in mixed order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceworks.llm import lines, minhash, mixing, pieces, quality
from traceworks.llm.common import drop_folder, recorded
from traceworks.session import checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Folders that the last stage of a run wrote in between, by session and source.
_left: dict[tuple[int, str], list[str]] = {}


def _tidy(stage: Stage) -> Stage:
    """A stage is called when its predecessor's result is stored: what that one wrote in between is deleted first."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        run_of = (id(spark), sf_dir)
        for folder in _left.pop(run_of, []):
            drop_folder(spark, folder)
        with recorded() as folders:
            result = stage(spark, docs, sf_dir)
        _left[run_of] = folders
        return result

    return run_stage


@_tidy
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is at least one half and that pass the base rules."""
    return quality.accepted(docs)


@_tidy
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand earlier, up to two edits; documents of which only blank lines are left go."""
    return lines.without_repeats(docs)


@_tidy
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.one_of_each(docs)


@_tidy
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that mixes the sources to their target weights."""
    return mixing.in_mixed_order(docs)


@_tidy
def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every document, and its ``position`` in the mix: task and file of the mixed table, row in the file."""
    name = F.col("_metadata.file_name")
    place = {"part": F.regexp_extract(name, r"^part-(\d+)", 1), "file": F.regexp_extract(name, r"-c(\d+)\.", 1),
             "row": F.col("_metadata.row_index")}
    return pieces.encode_texts(docs, carried=place).select(
        "doc_id", "n_pieces", "ids", "exact", F.struct(*place).alias("position"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("minhash near-dedup", near_dedup),
          ("source mixing", source_mixing), ("sentencepiece", sentencepiece)]
#: Expectation-maximisation, connected components and the Viterbi search are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}-{k}"
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
