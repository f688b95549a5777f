"""The registered queries of this subpackage, with check SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceworks.llm import (chat, fingerprints, lines, minhash, mixing, negatives, pieces, quality, substring, suffixdedup,
                            tokens, warc, whitening)
from traceworks.sources.tables import table

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        LLM_QUERIES[name] = fn
        if oracle is not None:
            LLM_ORACLES[name] = oracle
        return fn

    return wrap


@query("op1_sentencepiece")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.encode_texts(table(spark, sf, "documents")).select(
        "doc_id", "n_pieces", "ids", F.sha2("decoded", 256).alias("decoded_sha256"), "exact")


@query("op2_minhash_near_dedup")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents"), shingle=4)


@query("op3_substring_dedup")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_quality_rules")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return quality.verdicts(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


@query("op9_suffix_dedup")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    out = suffixdedup.remove_repeated_bytes(table(spark, sf, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_fingerprints")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.edited_likeness(table(spark, sf, "documents"))


@query("op4_chat_formatting")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    probe = spark.sql(r"""select -7L as conv_id, turn, role, r'\### Assistant: </turn> ok' as text
                          from values (0L, 'user'), (1L, 'assistant') as t(turn, role)""")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").union(probe)
    return chat.conversation_digests(chat.format_turns(rows))


@query("op5_warc")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    files = warc.write_archives(table(spark, sf, "pages"), folder)
    return warc.read_archives(spark, folder, files).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


@query("op6_source_mixing")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.schedule(table(spark, sf, "documents")).select("doc_id", "source", "block", "place", "slot")


@query("op7_line_dedup")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_hard_negatives", """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
    s AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
               CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
        FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    p AS (
        SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
    SELECT anchor_id, positive_id,
           CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
           other_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 3""")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.expr("CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS LONG) + 1) % 10 ELSE label END")
    return negatives.mine(negatives.prepared(table(spark, sf, "embeddings"), label=moved))


@query("op12_token_counts")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf, "documents"), limit=512)


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings")).select(
        "vec_id", "component", "n", F.expr("try_cast(deviation AS LONG)").alias("deviation"), "whitened", "explained",
        "identity_error")
