"""Which of many names occur in which texts: one automaton over the names, run once over every text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts and characters of names that meet in one task, on average.
TEXTS, NAME_CHARACTERS = 20_000, 4_000_000


def _hits(texts, names):
    """(text_id, name) of one block of texts and one block of names (Arrow tables)."""
    import ahocorasick

    out_ids, out_names = [], []
    if texts.num_rows and names.num_rows:
        spelt: dict[str, list[str]] = {}
        for piece, name in zip(names.column("piece").to_pylist(), names.column("name").to_pylist()):
            spelt.setdefault(piece, []).append(name)
        everywhere = spelt.pop("", [])
        automaton = ahocorasick.Automaton()
        for piece in spelt:
            automaton.add_word(piece, piece)
        if spelt:
            automaton.make_automaton()
        for i, body in zip(texts.column("text_id").to_pylist(), texts.column("body").to_pylist()):
            found = {piece for _, piece in automaton.iter(body)} if spelt else ()
            hits = [*everywhere, *(name for piece in found for name in spelt[piece])]
            out_ids += [i] * len(hits)
            out_names += hits
    return pa.table([pa.array(out_ids, pa.string()), pa.array(out_names, pa.string())], names=["text_id", "name"])


def names_in_texts(texts: DataFrame, id_col: str, text_col: str, names: DataFrame, name_col: str,
                   block: int = TEXTS, characters: int = NAME_CHARACTERS) -> DataFrame:
    """(text_id string, name): every name that occurs in a text, in any case, once per text.

    Texts and names are cut into blocks by hash; every pair of blocks is one group, in which an Aho-Corasick automaton
    of the names reads each text once. Names are one block until they are many, and none of them passes the driver.
    """
    body, piece = F.lower(F.col(text_col).cast("string")), F.lower(F.col(name_col).cast("string"))
    left = texts.select(F.col(id_col).cast("string").alias("text_id"), body.alias("body")).where("body is not null").distinct()
    right = names.select(F.col(name_col).cast("string").alias("name"), piece.alias("piece")).where("piece is not null").distinct()
    n_texts = max(1, -(-left.count() // block))
    n_names = max(1, -(-(right.agg(F.sum(F.length("piece") + 1)).first()[0] or 0) // characters))

    def dealt(df: DataFrame, keys: list[str], own: str, blocks: int, other: str, others: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    t = dealt(left, ["text_id", "body"], "tb", n_texts, "nb", n_names).groupBy("tb", "nb")
    n = dealt(right, ["name"], "nb", n_names, "tb", n_texts).groupBy("tb", "nb")
    return t.cogroup(n).applyInArrow(_hits, "text_id string, name string").distinct()
