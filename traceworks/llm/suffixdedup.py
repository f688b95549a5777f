"""Exact repeats of byte strings: suffix arrays of shards, common prefixes, and a merge across shards.

Every ``window`` bytes choose an anchor (``anchors.py``). Neighbourhoods of an anchor that occur more than once as a
whole are repeated by that alone. Where an anchor has several different neighbourhoods, they go to one shard, which
sorts their suffixes (Larsson-Sadakane) and finds windows that share ``window`` bytes or more by Kasai's common
prefixes. An anchor with more than ``SALT_ROWS`` neighbourhoods is split over several shards; each of them then cuts
its sorted window fingerprints into ranges by binary search, and a range's task merges the shards' lists by binary
search. All copies of a repeated string are removed, the first one too.

Defined results: null text is empty; rows equal in id and text are one document and each is returned; a null id is an
id like others; texts shorter than ``window`` bytes keep everything; an empty table gives an empty result. Columns
other than id and text are not read. What is left is bytes, since a cut may fall inside a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceworks.llm import grams
from traceworks.llm.anchors import allowed, anchored_runs, flat_shared, own, packed, places, raw_texts, with_shared
from traceworks.llm.common import keyed, with_list, written
from traceworks.llm.suffixes import common_prefixes, suffix_array

#: Neighbourhoods of one anchor that one shard takes, and the bytes after which a shard is closed.
SALT_ROWS = 256
SHARD_BYTES = 1 << 19
#: Width and share (one in SAMPLE_SCALE) of the grams by which a shard rules windows out before sorting suffixes.
SAMPLED, SAMPLE_SCALE = 16, 8

BLOCKS = "doc_id long, tag int, anchor long, block long, start int, n int"
PIECES = "anchor long, salt int, salts int, doc_id long, tag int, start int, n int, known boolean, piece binary"
FOUND = ("doc_id long, tag int, start int, n int, anchor long, part int, salt int, prints array<long>, "
         "owners array<long>, tags array<int>, starts array<int>, known array<boolean>")
KEPT = "doc_id long, n_bytes long, n_removed long, kept binary, spans array<struct<first:int,last:int>>"


def _byte_grams(texts: list[bytes], gram: int, window: int):
    """(bytes, first byte of each text, text of each byte, gram hashes, anchor of each window, window in one text)."""
    a = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    text = np.repeat(np.arange(len(texts)), lengths)
    g = grams.byte_grams(a, gram)
    n = max(0, len(a) - window + 1)
    return a, np.cumsum(lengths) - lengths, text, g, grams.lowest(g, window - gram + 1), text[:n] == text[len(a) - n :]


def _finder(gram: int, window: int):
    def find(texts: list[bytes]):
        _, _, text, g, best, inside = _byte_grams(texts, gram, window)
        at = places(best, inside)
        return g[at], text[at]

    return find


def _blocks(gram: int, window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_texts(batch.column("text"))
            for lo, hi in grams.chunked(texts):
                a, edge, text, g, best, inside = _byte_grams(texts[lo:hi], gram, window)
                found = allowed(best, inside, g, flat_shared(batch.column("shared")[lo:hi]))
                at, n = anchored_runs(found, best)
                if not len(at):
                    continue
                first, anchor = found[at], best[found[at]]
                sums = grams._prefix_sums(a)
                _, inverse = grams._power_tables(len(a) + 1)
                content = grams.mix((sums[first + n - 1 + window] - sums[first]) * inverse[first])
                content ^= grams.mix((anchor - first).astype(np.uint64) * np.uint64(1 << 20) + n.astype(np.uint64))
                of = pa.array(text[first])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:hi].take(of), batch.column("tag")[lo:hi].take(of),
                     pa.array(g[anchor].view(np.int64)), pa.array(content.view(np.int64)),
                     pa.array((first - edge[text[first]]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    ["doc_id", "tag", "anchor", "block", "start", "n"])

    return work


def _pieces(window: int):
    """The bytes of the neighbourhoods asked for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_texts(batch.column("text"))
            for lo, hi in grams.chunked(texts):
                of, part = own(batch, "asked", lo, hi)
                of = of + lo
                start, n = (part.field(c).to_pylist() for c in ("start", "n"))
                pieces = [texts[t][i : i + m - 1 + window] for t, i, m in zip(of, start, n)]
                yield pa.RecordBatch.from_arrays(
                    [part.field("anchor"), part.field("salt"), part.field("salts"),
                     batch.column("doc_id").take(pa.array(of)), batch.column("tag").take(pa.array(of)),
                     part.field("start"), part.field("n"), part.field("known"), pa.array(pieces, pa.binary())],
                    ["anchor", "salt", "salts", "doc_id", "tag", "start", "n", "known", "piece"])

    return work


def _shard(window: int):
    """Repeats among the pieces of a shard, and fingerprint lists for anchors that several shards share."""
    names = [c.split()[0] for c in FOUND.split(", ")]

    def closed(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        a = np.frombuffer(b"".join([r["piece"] for r in rows]), np.uint8)
        sizes = np.array([len(r["piece"]) for r in rows])
        edge, n = np.cumsum(sizes) - sizes, np.array([r["n"] for r in rows])
        # Windows that count: n from the start of each piece.
        row = np.repeat(np.arange(len(rows)), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = edge[row] + offset
        # Only windows whose sampled grams all occur twice in the shard can repeat in it; sort the suffixes of those.
        g = grams.byte_grams(a, SAMPLED)
        sample = np.flatnonzero(g < np.uint64((1 << 64) // SAMPLE_SCALE))
        _, which, times = np.unique(g[sample], return_inverse=True, return_counts=True)
        alone = np.zeros(len(a) + 2, np.int64)
        alone[sample[times[which] == 1] + 1] = 1
        alone = np.cumsum(alone)
        maybe = np.flatnonzero(alone[place + window - SAMPLED + 1] == alone[place])
        repeated = np.zeros(len(place), bool)
        if len(maybe):
            held = grams.covered(place[maybe], np.full(len(maybe), window), len(a))
            at = np.full(len(a), -1, np.int64)
            at[place[maybe]] = maybe
            at, text = at[held], a[held]
            depth = 8 << max(0, (window // 8).bit_length() - 1)
            sa, tied = suffix_array(text, depth)
            group = np.cumsum(common_prefixes(text, sa, tied, depth, window) < window)
            counted = at[sa] >= 0
            windows, group = at[sa[counted]], group[counted]
            repeated[windows] = np.bincount(group)[group] > 1
        known = np.array([r["known"] for r in rows])
        hit = np.flatnonzero(repeated & ~known[row])
        cut = np.ones(len(hit), bool)
        cut[1:] = (np.diff(hit) != 1) | (np.diff(row[hit]) != 0)
        first = np.flatnonzero(cut)
        length = np.diff(np.append(first, len(hit)))
        out = [{"doc_id": rows[row[w]]["doc_id"], "tag": rows[row[w]]["tag"],
                "start": rows[row[w]]["start"] + int(offset[w]), "n": int(m)} for w, m in zip(hit[first], length)]
        if any(r["salts"] > 1 for r in rows):
            prints = grams.byte_grams(a, window)[place]
            keys = sorted({(r["anchor"], r["salt"], r["salts"]) for r in rows if r["salts"] > 1})
            for anchor, salt, salts in keys:
                mine = np.array([(r["anchor"], r["salt"]) == (anchor, salt) for r in rows])
                held = np.flatnonzero(mine[row])
                _, one = np.unique(prints[held], return_index=True)
                own = held[one]
                bounds = np.array([(k << 64) // salts for k in range(1, salts)], np.uint64)
                ends = np.concatenate(([0], np.searchsorted(prints[own], bounds), [len(own)]))
                for part in range(salts):
                    some = own[ends[part] : ends[part + 1]]
                    if len(some):
                        out.append({
                            "anchor": anchor, "part": part, "salt": salt, "prints": prints[some].view(np.int64).tolist(),
                            "owners": [rows[i]["doc_id"] for i in row[some]], "tags": [rows[i]["tag"] for i in row[some]],
                            "starts": [rows[i]["start"] + int(k) for i, k in zip(row[some], offset[some])],
                            "known": (repeated[some] | known[row[some]]).tolist()})
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(),
                 pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()),
                 pa.list_(pa.bool_())]
        for i in range(0, len(out), 2000):
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.get(c) for r in out[i : i + 2000]], k) for c, k in zip(names, kinds)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            for r in batch.to_pylist():
                key = (r["anchor"], r["salt"])
                if size > SHARD_BYTES and key != last:
                    yield from closed(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r["piece"])
                last = key
        if rows:
            yield from closed(rows)

    return work


def _merge(key, tables):
    """Windows whose fingerprint another shard's list of the same range holds too (Arrow table to Arrow table)."""
    lists = [np.sort(np.array(x, np.int64)) for x in tables.column("prints").to_pylist()]
    out = {"doc_id": [], "tag": [], "start": [], "n": []}
    for i in range(len(lists)):
        row = tables.slice(i, 1)
        own = np.array(row.column("prints")[0].as_py(), np.int64)
        found = np.array(row.column("known")[0].as_py())
        skip = found.copy()
        for j in range(len(lists)):
            if j != i:
                at = np.minimum(np.searchsorted(lists[j], own), len(lists[j]) - 1)
                found |= lists[j][at] == own
        for k in np.flatnonzero(found & ~skip):
            for name, column in (("doc_id", "owners"), ("tag", "tags"), ("start", "starts")):
                out[name].append(row.column(column)[0][int(k)].as_py())
            out["n"].append(1)
    return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "tag": pa.array(out["tag"], pa.int32()),
                     "start": pa.array(out["start"], pa.int32()), "n": pa.array(out["n"], pa.int32())})


def _cut(window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_texts(batch.column("text"))
            for lo, hi in grams.chunked(texts):
                of, found = own(batch, "found", lo, hi)
                start, n = (found.field(c).to_numpy().astype(np.int64) for c in ("start", "n"))
                edges = np.searchsorted(of, np.arange(hi - lo + 1))
                kept, removed, spans, n_spans = [], [], [], []
                for t in range(lo, hi):
                    a = np.frombuffer(texts[t], np.uint8)
                    mine = slice(edges[t - lo], edges[t - lo + 1])
                    out = grams.covered(start[mine], n[mine] + window - 1, len(a))
                    edge = np.diff(np.concatenate(([0], out.view(np.int8), [0])))
                    runs = np.stack((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1), 1)
                    kept.append(a[~out].tobytes())
                    removed.append(int(out.sum()))
                    spans.append(runs)
                    n_spans.append(len(runs))
                pairs = np.concatenate(spans).astype(np.int32)
                offsets = np.append(0, np.cumsum(n_spans)).astype(np.int32)
                struct = pa.StructArray.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["first", "last"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:hi], pa.array([len(t) for t in texts[lo:hi]], pa.int64()),
                     pa.array(removed, pa.int64()), pa.array(kept, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(offsets), struct)],
                    ["doc_id", "n_bytes", "n_removed", "kept", "spans"])

    return work


def remove_repeated_bytes(docs: DataFrame, window: int = 400, gram: int = 32, id_col: str = "doc_id",
                          text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, kept, spans): bytes left after removing all that a repeated window covers.

    ``kept`` is binary; ``spans`` are the maximal removed byte ranges, both ends included.
    """
    docs = keyed(docs, id_col, text_col)
    small = packed(docs)  # once: all joins with it share one exchange
    blocks = with_shared(docs, small, _finder(gram, window), keep=True).where("shared is not null").mapInArrow(
        _blocks(gram, window), BLOCKS)
    blocks = written(blocks, "blocks")  # three tables come from it
    place = ["doc_id", "tag", "start", "n"]
    # Every distinct block at its first and last place; the hash of its content tells its anchor too.
    index = blocks.groupBy("block").agg(
        F.min(F.struct(*place, "anchor")).alias("at"), F.max(F.struct(*place, "anchor")).alias("last"))
    copies = blocks.join(index.where("at != last").select("block"), "block").select(*place)

    first = index.select("at.*", "block", (F.col("at") != F.col("last")).alias("known"))
    several = first.groupBy("anchor").agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1").select(
        "anchor", F.ceil(F.col("blocks") / SALT_ROWS).cast("int").alias("salts"))
    asked = first.join(several, "anchor").select(
        *place, "anchor", F.expr("cast(pmod(block, salts) as int)").alias("salt"), "salts", "known")
    pieces = with_list(small, asked, "asked").where("asked is not null").mapInArrow(_pieces(window), PIECES)
    shards = written(pieces.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(
        _shard(window), FOUND), "shards")  # sorted once for what is found inside and across
    inside = shards.where("anchor is null").select(*place)
    across = shards.where("anchor is not null").select(
        "anchor", "part", "prints", "owners", "tags", "starts", "known").groupBy("anchor", "part").applyInArrow(
        _merge, "doc_id long, tag int, start int, n int")
    return with_list(small, copies.union(inside).union(across), "found").withColumn(
        "found", F.coalesce("found", F.array().cast("array<struct<tag:int,start:int,n:int>>"))).mapInArrow(
        _cut(window), KEPT)
