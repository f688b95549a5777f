"""Content-chosen anchors: places where equal passages of different texts are sure to be compared.

Of every ``window`` consecutive words (or bytes) the lowest-hashed ``gram`` is an anchor. Equal windows choose the same
anchor at the same place, so a window can occur twice only if its anchor does. Only anchors travel, about
2 / (window - gram + 2) of the places, and they are counted with partial sums before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceworks.llm import grams
from traceworks.llm.common import own_key, with_list, written

ANCHORS = "own long, anchors array<long>, again array<boolean>"


def raw_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of texts, given as they are or as ``packed`` leaves them."""
    if pa.types.is_binary(column.type):
        codec = pa.Codec("zstd")
        return [codec.decompress(x[8:], int.from_bytes(x[:8]), asbytes=True) if len(x) > 8 else b""
                for x in column.to_pylist()]
    return column.cast(pa.binary()).to_pylist()


def packed(docs: DataFrame) -> DataFrame:
    """``keyed`` texts, compressed one by one: what an exchange of whole texts moves and keeps on disk shrinks by a third.

    A packed text is its size in eight bytes and the compressed bytes.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 3)
        for batch in batches:
            small = [len(x).to_bytes(8) + (codec.compress(x, asbytes=True) if x else b"")
                     for x in raw_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(small, pa.binary())],
                                             ["doc_id", "tag", "text"])

    return docs.mapInArrow(work, "doc_id long, tag int, text binary")


def word_grams(texts: list[bytes], gram: int, window: int):
    """(words, gram hashes, anchor place of each window of words, whether the window lies in one text)."""
    w = grams.words(texts)
    g = grams.runs(w.hashes, gram)
    return w, g, grams.lowest(g, window - gram + 1), w.within(window)


def places(best: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The distinct anchor places of the windows that lie in one text, ascending."""
    at = best[inside]
    return at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def anchor_rows(docs: DataFrame, find: Callable) -> DataFrame:
    """One row per document with its distinct anchors. ``find(texts)`` gives anchor hashes and the text of each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_texts(batch.column("text"))
            for lo, hi in grams.chunked(texts):
                hashes, text = find(texts[lo:hi])
                order = np.lexsort((hashes, text))
                hashes, text = hashes[order], text[order]
                new = np.ones(len(hashes), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
                at = np.flatnonzero(new)
                again = np.diff(np.append(at, len(hashes))) > 1
                counts = np.bincount(text[at], minlength=hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("own")[lo:hi],
                     list_column(hashes[at].view(np.int64), counts, pa.int64()),
                     list_column(again, counts, pa.bool_())], ["own", "anchors", "again"])

    return docs.select(own_key().alias("own"), "text").mapInArrow(work, ANCHORS)


def with_shared(docs: DataFrame, small: DataFrame, find: Callable, keep: bool = False) -> DataFrame:
    """``small``, which is ``docs`` packed, with ``shared``: its anchors that occur more than once anywhere (null where it has none).

    The anchors are needed twice: ``keep`` writes them to the shared folder instead of finding them again.
    """
    one = anchor_rows(docs, find).select("own", F.explode(F.arrays_zip("anchors", "again")).alias("a")).select(
        "own", F.col("a.anchors").alias("anchor"), F.col("a.again").alias("again"))
    one = written(one, "anchors") if keep else one
    shared = one.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again")).where(
        "n > 1 or again").select("anchor")
    return with_list(small, one.select("own", "anchor").join(shared, "anchor"), "shared")


def own(batch: pa.RecordBatch, name: str, lo: int, hi: int) -> tuple[np.ndarray, pa.StructArray]:
    """Items of a list column for texts ``lo`` to ``hi`` that carry the text's own tag, and the text of each."""
    lists = batch.column(name)[lo:hi]
    items = lists.flatten()
    text = np.repeat(np.arange(hi - lo), np.diff(lists.offsets.to_numpy()))
    if lists.null_count:
        text = np.repeat(np.arange(hi - lo), lists.value_lengths().fill_null(0).to_numpy())
    mine = items.field("tag").to_numpy() == batch.column("tag")[lo:hi].to_numpy()[text]
    return text[mine], items.filter(pa.array(mine))


def allowed(best: np.ndarray, inside: np.ndarray, hashes: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Windows that may occur twice: those whose own anchor is shared."""
    at = places(best, inside)
    common = np.zeros(len(hashes), bool)
    common[at[np.isin(hashes[at], shared)]] = True
    i = np.flatnonzero(inside)
    return i[common[best[i]]]


def anchored_runs(windows: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of consecutive windows with one anchor: index of the first window in ``windows``, and lengths."""
    if not len(windows):
        return windows, windows
    cut = np.ones(len(windows), bool)
    cut[1:] = (np.diff(windows) != 1) | (np.diff(best[windows]) != 0)
    at = np.flatnonzero(cut)
    return at, np.diff(np.append(at, len(windows)))


def flat_shared(column: pa.Array) -> np.ndarray:
    """All values of a list column."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
