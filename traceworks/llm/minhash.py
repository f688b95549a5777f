"""Near-duplicate documents by MinHash: universal hash minima, banding, two checks, connected components.

Texts with equal shingle sets form a class at once. Class representatives are banded; in every bucket the members are
first compared with the bucket's smallest and largest member, by signature and then on the full shingle sets. Buckets that still hold several components are compared in full: their
members are cut into blocks, a task takes two blocks at a time with their full sets, and hands on only as many links as
tie its members together. So no link between components is missed for want of a comparison, pairs inside a component
need none, and no list of pairs is made, however large a bucket is.

With 24 bands of 4 minima a pair of likeness 0.8 shares no bucket with a chance of 3 in a million.

Defined results: words are runs without ASCII white space, A-Z lower-cased; null or empty texts have an empty set and
are linked with nothing; a text with fewer words than a shingle has its whole word sequence as one shingle; rows that
share an id are one document and are linked; rows without id are linked with nothing and kept, their component null;
an empty table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceworks.llm import grams
from traceworks.llm.anchors import list_column, raw_texts
from traceworks.llm.common import boxed, drop_written, keyed, written
from traceworks.llm.components import connected_components

BANDS, ROWS = 24, 4
#: Signature likeness below the threshold by so much (over six standard errors) rules a pair out.
SLACK = 0.25
#: Members of one block of a bucket that is compared in full.
BLOCK = 256
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 61, BANDS * ROWS, np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 61, BANDS * ROWS, np.uint64)

SKETCH = "doc_id long, body long, n long, set_a long, set_b long, bands array<long>, signature binary"


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, in one array, and how many each text has."""
    w = grams.words([t.lower() for t in texts])
    at = np.flatnonzero(w.within(k))
    hashes, text = grams.runs(w.hashes, k)[at], w.text[at]
    counts = np.diff(w.first)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = [np.bitwise_xor.reduce(grams.mix(w.hashes[w.first[t] : w.first[t + 1]]
                                                 + np.arange(1, counts[t] + 1, dtype=np.uint64)))
                 + np.uint64(counts[t]) for t in short]
        hashes, text = np.append(hashes, np.array(whole, np.uint64)), np.append(text, short)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.bincount(text[new], minlength=len(texts))


def minima(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The lowest value of each universal hash a*x+b (upper 32 bits of the product) over each non-empty set."""
    filled = np.flatnonzero(counts)
    edge = (np.cumsum(counts) - counts)[filled]
    out = np.empty((len(filled), len(_A)), np.uint32)
    for j in range(len(_A)):
        values = ((hashes * _A[j] + _B[j]) >> np.uint64(32)).astype(np.uint32)
        out[:, j] = np.minimum.reduceat(values, edge)
    return out


def _sketches(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_texts(batch.column("text"))
            for lo, hi in grams.chunked(texts):
                hashes, counts = shingle_sets(texts[lo:hi], k)
                filled = np.flatnonzero(counts)
                bands, signature = np.zeros((0, BANDS), np.uint64), []
                digests = np.zeros((2, hi - lo), np.uint64)
                if len(filled):
                    low = minima(hashes, counts)
                    edge = (np.cumsum(counts) - counts)[filled]
                    digests[0, filled] = np.add.reduceat(grams.mix(hashes), edge)
                    digests[1, filled] = np.bitwise_xor.reduceat(grams.mix(hashes ^ np.uint64(0xA5A5A5A5)), edge)
                    bands = np.zeros((len(filled), BANDS), np.uint64)
                    for r in range(ROWS):
                        bands = bands * np.uint64(0xD6E8FEB86659FD93) + grams.mix(low[:, r::ROWS].astype(np.uint64))
                    bands = grams.mix(bands + np.arange(BANDS, dtype=np.uint64))
                    short = low.astype(np.uint16)
                    signature = [row.tobytes() for row in short]
                signatures = [b""] * (hi - lo)
                for i, s in zip(filled, signature):
                    signatures[i] = s
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:hi], batch.column("body")[lo:hi], pa.array(counts, pa.int64()), pa.array(digests[0].view(np.int64)),
                     pa.array(digests[1].view(np.int64)),
                     list_column(bands.ravel().view(np.int64), np.where(counts > 0, BANDS, 0), pa.int64()),
                     pa.array(signatures, pa.binary())],
                    ["doc_id", "body", "n", "set_a", "set_b", "bands", "signature"])

    return work


def _alike(least: float):
    """Pairs whose signatures agree often enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = np.frombuffer(b"".join(batch.column("sig_a").to_pylist()), np.uint16).reshape(-1, BANDS * ROWS)
            b = np.frombuffer(b"".join(batch.column("sig_b").to_pylist()), np.uint16).reshape(-1, BANDS * ROWS)
            yield batch.filter(pa.array((a == b).mean(1) >= least)).select(["a", "b"])

    return work


def _confirmed(k: int, percent: int):
    """Pairs whose full sets meet the threshold: 100 * intersection >= percent * union."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                n = batch.num_rows
                texts = raw_texts(batch.column("text_a")) + raw_texts(batch.column("text_b"))
                hashes, counts = shingle_sets(texts, k)
                edge = np.append(0, np.cumsum(counts))
                good = np.zeros(n, bool)
                for i in range(n):
                    x, y = hashes[edge[i] : edge[i + 1]], hashes[edge[n + i] : edge[n + i + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good[i] = 100 * both >= percent * (len(x) + len(y) - both) > 0
                yield batch.filter(pa.array(good)).select(["a", "b"])

    return work


def _tied(k: int, percent: int):
    """Links that tie the members of two blocks together (Arrow table to Arrow table): every component's members to its first."""

    def work(members):
        hashes, counts = shingle_sets(raw_texts(members.column("text").combine_chunks()), k)
        n = len(counts)
        _, column, times = np.unique(hashes, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(n), counts)
        both = times[column] > 1
        row, column = row[both], np.unique(column[both], return_inverse=True)[1]
        order = np.argsort(column)
        row, column = row[order], column[order]
        shared = np.zeros((n, n), np.float32)
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            part = slice(*np.searchsorted(column, (lo, lo + 4096)))
            held = np.zeros((n, 4096), np.float32)
            held[row[part], column[part] - lo] = 1
            shared += held @ held.T
        sizes = counts.astype(np.float32)
        linked = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
        label = np.arange(n)
        while True:
            lower = np.where(linked, label[None, :], n).min(axis=1)
            lower = np.minimum(lower, label)
            if (lower == label).all():
                break
            label = lower
        nodes = members.column("node").to_numpy()
        at = np.flatnonzero(label != np.arange(n))
        return pa.table({"a": pa.array(nodes[label[at]]), "b": pa.array(nodes[at])})

    return work


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row; ``kept`` marks the smallest id of each component."""
    docs = keyed(docs, id_col, text_col).withColumn("body", F.xxhash64("text"))
    sketch = written(docs.mapInArrow(_sketches(shingle), SKETCH).withColumn("row", F.monotonically_increasing_id()),
                     "sketches")
    sets = ["set_a", "set_b", "n"]
    # A class of equal sets is named by one of its rows, since rows of one id may be of several classes.
    classes = written(sketch.where("n > 0 and doc_id is not null").groupBy(*sets).agg(
        F.min("row").alias("node"), F.min("doc_id").alias("least")), "classes")
    s, c = sketch.select("doc_id", *sets).alias("s"), classes.alias("c")
    equal = [F.col(f"s.{x}") == F.col(f"c.{x}") for x in sets]
    placed = written(s.join(c, [*equal, F.col("s.n") > 0, F.col("s.doc_id").isNotNull()], "left").select(
        "s.doc_id", "s.n", "c.node"), "placed")
    nodes = sketch.join(classes.select("node"), F.col("row") == F.col("node"))
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi")
    members = written(buckets.join(shared, "bucket"), "buckets")
    wanted = members.select("node").distinct()
    signatures = written(nodes.join(wanted, "node").select("node", "doc_id", "body", "signature"), "signatures")
    drop_written(sketch)
    texts = written(docs.join(signatures.select("node", "doc_id", "body"), ["doc_id", "body"]).groupBy("node").agg(
        F.min("text").alias("text")), "texts")

    def links(pairs: DataFrame) -> DataFrame:
        def sided(column: str, side: str, source: DataFrame, value: str) -> DataFrame:
            return source.select(F.col("node").alias(side), F.col(value).alias(f"{column}_{side}"))

        near = pairs.join(sided("sig", "a", signatures, "signature"), "a").join(
            sided("sig", "b", signatures, "signature"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(
            _alike(percent / 100 - SLACK), "a long, b long")
        return near.join(sided("text", "a", texts, "text"), "a").join(sided("text", "b", texts, "text"), "b").select(
            "a", "b", "text_a", "text_b").mapInArrow(_confirmed(shingle, percent), "a long, b long")

    # Rows that share an id join their classes.
    several = placed.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a != b")
    same_id = placed.join(several.select("doc_id", "a"), "doc_id").where("node != a").select(
        "a", F.col("node").alias("b")).distinct()
    # Two centres per bucket: its smallest and its largest member.
    stars = members.select("node", F.explode(F.array("lo", "hi")).alias("centre")).where("node != centre").select(
        F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    found = written(same_id.union(links(stars)), "links")
    labels = written(connected_components(found, "a", "b"), "labels")

    def labelled(rows: DataFrame, node: str, name: str) -> DataFrame:
        label = labels.select(F.col("node").alias(node), F.col("component").alias(name))
        return rows.join(label, node, "left").withColumn(name, F.coalesce(name, node))

    # Buckets that still hold several components: their members, across components only.
    held = labelled(members.select("bucket", "node"), "node", "component")
    mixed = held.groupBy("bucket").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.ceil(F.count(F.lit(1)) / BLOCK).cast(
            "int").alias("blocks")).where("x != y").select("bucket", "blocks")
    held = members.select("bucket", "node").join(mixed, "bucket").withColumn(
        "own", F.expr("cast(pmod(xxhash64(node), blocks) as int)")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = held.select("bucket", "node", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    tied = held.join(texts, "node").groupBy("bucket", "lo", "hi").applyInArrow(_tied(shingle, percent), "a long, b long")
    every = written(found.union(tied), "links")
    for table in (members, signatures, texts, found, labels):
        drop_written(table)
    labels = connected_components(every, "a", "b")
    drop_written(every)

    # A component is named by the smallest id of its classes.
    linked = classes.select("node", "least").join(labels, "node")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    names = classes.select("node", "least").join(
        linked.join(least, "component").select("node", "component_id"), "node", "left").select(
        "node", F.coalesce("component_id", "least").alias("component_id"))
    component = F.coalesce("component_id", "doc_id")
    return placed.join(names, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document is the smallest id of its component, with all their columns."""
    gone = near_duplicates(docs, shingle, percent, id_col, text_col).where("not kept").select("doc_id").distinct()
    rows = boxed(docs, id_col, text_col).select("doc_id", "row")
    return rows.join(gone, rows["doc_id"] == gone["doc_id"], "left_anti").select("row.*")
