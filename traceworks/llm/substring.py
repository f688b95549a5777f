"""Exact repeats of word passages: content-chosen blocks looked up by hash, other windows one by one.

The reference is all text; its blocks are the neighbourhoods of anchors (``anchors.py``), indexed by content, each kept at
its earliest occurrence. The block at every anchor of a document is looked up in the index, and a block found earlier is
removed whole. What is left are windows of neighbourhoods that differ; they are checked one by one against the blocks with
the same anchor. No greedy factors are made, so this is no relative Lempel-Ziv parsing; removed windows
that overlap or touch join into one span.

Defined results: null text has no words; rows equal in id and text are one document and each is returned; rows that
share an id but not the text are ordered by a digest of the text; a null id sorts before all others; a document with
fewer than ``window`` words keeps them all; an empty table gives an empty result. Columns other than id and text are
not read. Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceworks.llm import grams
from traceworks.llm.anchors import (allowed, anchored_runs, flat_shared, own, packed, places, raw_texts, with_shared,
                                    word_grams)
from traceworks.llm.common import keyed, with_list

#: A block's key is a 64-bit hash of its content. The 32 bits of its anchor only choose what is checked window by window.
BLOCKS = "doc_id long, tag int, block long, anchor int, start int, n int"
WINDOWS = "doc_id long, tag int, start int, hash long"
KEPT = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<first:int,last:int>>"


def _finder(gram: int, window: int):
    def find(texts: list[bytes]):
        w, g, best, inside = word_grams(texts, gram, window)
        at = places(best, inside)
        return g[at], w.text[at]

    return find


def _blocks(gram: int, window: int):
    """The blocks of each document: runs of windows that share an anchor, with a hash of their content."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_texts(batch.column("text"))
            for lo, hi in grams.chunked(texts):
                w, g, best, inside = word_grams(texts[lo:hi], gram, window)
                found = allowed(best, inside, g, flat_shared(batch.column("shared")[lo:hi]))
                at, n = anchored_runs(found, best)
                if not len(at):
                    continue
                first, anchor = found[at], best[found[at]]
                # Content of a block: its words from the first window's start to the last window's end.
                sums = np.zeros(len(w.hashes) + 1, np.uint64)
                powers, inverse = grams._power_tables(len(w.hashes) + 1)
                np.cumsum(w.hashes * powers[: len(w.hashes)], out=sums[1:])
                content = grams.mix((sums[first + n - 1 + window] - sums[first]) * inverse[first])
                content ^= grams.mix((anchor - first).astype(np.uint64) * np.uint64(1 << 20) + n.astype(np.uint64))
                text = w.text[first]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:hi].take(pa.array(text)), batch.column("tag")[lo:hi].take(pa.array(text)),
                     pa.array(content.view(np.int64)), pa.array(grams.mix(g[anchor]).astype(np.uint32).view(np.int32)),
                     pa.array((first - w.first[text]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    ["doc_id", "tag", "block", "anchor", "start", "n"])

    return work


def _windows(window: int):
    """Hashes of the windows asked for: ``asked`` has runs (start, n) of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_texts(batch.column("text"))
            for lo, hi in grams.chunked(texts):
                w = grams.words(texts[lo:hi])
                h = grams.runs(w.hashes, window)
                text, asked = own(batch, "asked", lo, hi)
                start = asked.field("start").to_numpy().astype(np.int64)
                n = asked.field("n").to_numpy().astype(np.int64)
                text = np.repeat(text, n)
                place = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:hi].take(pa.array(text)), batch.column("tag")[lo:hi].take(pa.array(text)),
                     pa.array(place.astype(np.int32)), pa.array(h[w.first[text] + place].view(np.int64))],
                    ["doc_id", "tag", "start", "hash"])

    return work


def _cut(window: int):
    """Take the duplicate spans out of the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_texts(batch.column("text"))
            for lo, hi in grams.chunked(texts):
                w = grams.words(texts[lo:hi])
                text, found = own(batch, "found", lo, hi)
                start = w.first[text] + found.field("start").to_numpy().astype(np.int64)
                out = grams.covered(start, found.field("n").to_numpy().astype(np.int64) + window - 1, len(w.starts))
                kept, spans, n_spans, removed = [], [], [], []
                for t in range(hi - lo):
                    a, b = w.first[t], w.first[t + 1]
                    keep = np.flatnonzero(~out[a:b]) + a
                    removed.append(int(b - a - len(keep)))
                    kept.append(b" ".join([w.raw[i:j] for i, j in zip(w.starts[keep], w.ends[keep])]))
                    edge = np.diff(np.concatenate(([0], out[a:b].view(np.int8), [0])))
                    runs = list(zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1))
                    n_spans.append(len(runs))
                    spans += runs
                pairs = np.array(spans, np.int32).reshape(-1, 2)
                struct = pa.StructArray.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["first", "last"])
                offsets = np.zeros(hi - lo + 1, np.int32)
                np.cumsum(n_spans, out=offsets[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:hi], pa.array(np.diff(w.first), pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(kept, pa.binary()).cast(pa.string()),
                     pa.ListArray.from_arrays(pa.array(offsets), struct)],
                    ["doc_id", "n_words", "n_removed", "kept", "spans"])

    return work


def remove_repeats(docs: DataFrame, window: int = 20, gram: int = 5, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans): words left after removing every repeated window but its first.

    ``kept`` is the text of the words left, joined by a space; ``spans`` are the removed word ranges, both ends
    included. A window repeats if its words also start earlier: in a smaller id, or earlier in the same document.
    """
    docs = keyed(docs, id_col, text_col)
    small = packed(docs)  # once: all joins with it share one exchange
    blocks = with_shared(docs, small, _finder(gram, window)).where("shared is not null").mapInArrow(
        _blocks(gram, window), BLOCKS)
    place = ["doc_id", "tag", "start"]
    # The index: every distinct block at its earliest place. The hash of a block's content tells its anchor too.
    index = blocks.groupBy("block").agg(
        F.min(F.struct(*place, "n", "anchor")).alias("at"), F.count(F.lit(1)).alias("places"))
    # Blocks that the index has earlier are removed whole.
    copies = blocks.select("block", *place, "n").join(index.where("places > 1").select("block", "at"), "block").where(
        ~_at_place()).select(*place, "n")
    # First occurrences whose anchor has other blocks too are checked window by window.
    first = index.select("at.*")
    several = first.groupBy("anchor").agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1").select("anchor")
    asked = first.join(several, "anchor", "left_semi").select(*place, "n")
    windows = with_list(small, asked, "asked").where("asked is not null").mapInArrow(_windows(window), WINDOWS)
    twice = windows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    windows = windows.join(twice, "hash")
    earliest = windows.groupBy("hash").agg(F.min(F.struct(*place)).alias("at"))
    checked = windows.join(earliest, "hash").where(~_at_place()).select(*place, F.lit(1).alias("n"))
    return with_list(small, copies.union(checked).distinct(), "found").withColumn(
        "found", F.coalesce("found", F.array().cast("array<struct<tag:int,start:int,n:int>>"))).mapInArrow(
        _cut(window), KEPT)


def _at_place() -> Column:
    """Whether a row stands at the place ``at``."""
    return F.col("doc_id").eqNullSafe(F.col("at.doc_id")) & (F.col("tag") == F.col("at.tag")) & (
        F.col("start") == F.col("at.start"))
