"""Hard negatives by a vertical scan of columnar blocks (BOND: branch and bound on decomposed vectors).

Rows are dealt into blocks that hold one array per dimension, anchors into chunks; every pair of block and chunk is
one group of bounded size. For an anchor, a block's dimensions are read in descending order of the anchor's magnitude.
After every few of them a row's score lies between its partial sum plus the least and plus the greatest contribution
that the dimensions still to come can make, by their minima and maxima in the block. Rows whose bounds rule them out
leave the candidate bitmap; what is left at the end has exact scores. A first scan finds each anchor's positives, a
second one the negatives inside the windows that the positives' scores set. Both are exact for every block and their
best rows are merged, so that no row is dropped by a cap.

Defined results: rows with a null label, a null vector or a null or non-finite entry take no part. Entries are floored
after scaling and count as 2**26 at most on either side, so that scores stay exact. Shorter vectors count as filled up with zeros. Rows that agree
in id, label and vector are one row; rows that share only the id stay apart, and none is a partner of an anchor with
its id. Rows without an id are no anchors; as partners they come after equal scores with an id. A negative positive
score has no window. Empty tables give empty results. Columns other than id, label and vector are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceworks.llm.common import written
from traceworks.llm.vectors import matrix, usable, whole_steps

#: Entries in a block of rows, and in a chunk of anchors, on average.
BLOCK, CHUNK = 1 << 18, 1 << 16
#: Scaled entries are not above this.
MOST = 1 << 26
#: Dimensions are read in so many steps, with the bounds looked at after each.
STEPS = 8
SCALE, POSITIVES, NEGATIVES, LEAST, GREATEST = 256, 5, 3, 50, 95
BLOCKS = "block int, ids array<long>, labels array<long>, dims int, columns binary"
CHUNKS = "chunk int, ids array<long>, tags array<long>, labels array<long>, dims int, rows binary"
WINDOWS = "owners array<long>, places array<long>, positives array<long>, scores array<long>"
FOUND = "anchor_id long, tag long, positive_id long, positive_score long"
MINED = "anchor_id long, tag long, place long, positive_id long, positive_score long, negative_id long, negative_score long"


def prepared(rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
             label: Column | None = None, scale: float = SCALE) -> DataFrame:
    """(vec_id, label, x, tag): rows that take part, once each, with whole entries and a digest of label and vector."""
    vector = F.col(vector_col)
    label = (F.col(label_col) if label is None else label).cast("long")
    out = rows.where(usable(vector) & label.isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), whole_steps(vector, scale, MOST).alias("x"))
    return out.dropDuplicates(["vec_id", "label", "x"]).withColumn("tag", F.xxhash64("label", "x"))


def _pack_block(key, table):  # without type hints, which applyInArrow would have to know
    dims = int(np.max(pc.list_value_length(table.column("x")).to_numpy(), initial=0))
    columns = np.ascontiguousarray(matrix(table.column("x"), dims, np.int32).T)
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([table.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                     pa.array([table.column("label").to_pylist()], pa.list_(pa.int64())), pa.array([dims], pa.int32()),
                     pa.array([columns.tobytes()], pa.binary())], names=["block", "ids", "labels", "dims", "columns"])


def _pack_chunk(key, table):
    """One chunk of anchors; with positives, also the anchor's place, the id and the score of each."""
    dims = int(np.max(pc.list_value_length(table.column("x")).to_numpy(), initial=0))
    rows = matrix(table.column("x"), dims, np.int32)
    kinds = {"chunk": ([key[0].as_py()], pa.int32()), "ids": ([table.column("vec_id").to_pylist()], pa.list_(pa.int64())),
             "tags": ([table.column("tag").to_pylist()], pa.list_(pa.int64())),
             "labels": ([table.column("label").to_pylist()], pa.list_(pa.int64())), "dims": ([dims], pa.int32()),
             "rows": ([rows.tobytes()], pa.binary())}
    if "positives" in table.column_names:
        known = [(a, p["rank"], p["positive_id"], p["positive_score"])
                 for a, found in enumerate(table.column("positives").to_pylist()) for p in found]
        for name, values in zip(("owners", "places", "positives", "scores"), zip(*known)):
            kinds[name] = ([list(values)], pa.list_(pa.int64()))
    return pa.table([pa.array(v, t) for v, t in kinds.values()], names=list(kinds))


class Block:
    """The columns of a block and an anchor chunk's rows, in numbers that add up exactly."""

    def __init__(self, block: pa.Table, chunk: pa.Table):
        one, two = block.to_pylist()[0], chunk.to_pylist()[0]
        n, m = len(one["ids"]), len(two["ids"])
        columns = np.frombuffer(one["columns"], np.int32).reshape(one["dims"], n)
        rows = np.frombuffer(two["rows"], np.int32).reshape(m, two["dims"])
        dims = min(one["dims"], two["dims"])  # dimensions that only one side has add nothing
        columns, rows = columns[:dims].astype(np.int64), rows[:, :dims].astype(np.int64)
        if dims * int(np.abs(columns).max(initial=0)) * int(np.abs(rows).max(initial=0)) < 1 << 53:
            columns, rows = columns.astype(np.float64), rows.astype(np.float64)  # whole numbers below 2**53 are exact
        self.columns, self.rows = columns, rows
        self.least, self.most = columns.min(axis=1, initial=0), columns.max(axis=1, initial=0)
        self.given = one["ids"]
        missing = np.array([i is None for i in one["ids"]], bool)
        self.ids = np.array([0 if i is None else i for i in one["ids"]], np.int64)
        self.missing, self.labels = missing, np.array(one["labels"], np.int64)
        self.anchors = two

    def scan(self, a: int, alive: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """Rows left in the bitmap ``alive`` and their exact scores for anchor ``a``.

        ``keep`` says, given the lower and upper bounds of the rows left, which of them stay.
        """
        q = self.rows[a]
        order = np.argsort(-np.abs(q), kind="stable")
        order = order[: np.count_nonzero(q)]
        ends = np.minimum(q * self.least, q * self.most)[order], np.maximum(q * self.least, q * self.most)[order]
        low, high = (np.append(np.cumsum(e[::-1])[::-1], 0) for e in ends)
        left = np.flatnonzero(alive)
        score = np.zeros(len(left), self.columns.dtype)
        cuts = np.unique(np.linspace(0, len(order), STEPS + 1).astype(int))
        for start, stop in zip(cuts[:-1], cuts[1:]):
            dims = order[start:stop]
            score += q[dims] @ self.columns[np.ix_(dims, left)]
            stays = keep(score + low[stop], score + high[stop])
            alive[left[~stays]] = False
            left, score = left[stays], score[stays]
        return left, score.astype(np.int64)

    def first(self, rows: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        """Places of the ``k`` best: by falling score, ties by id, rows without one last."""
        return np.lexsort((self.ids[rows], self.missing[rows], -score))[:k]


def best(k: int):
    """Keeps rows that may be among the ``k`` highest scores."""

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if len(low) <= k:
            return np.ones(len(low), bool)
        return high >= np.partition(low, len(low) - k)[len(low) - k]

    return keep


def inside(windows: list[tuple[int, int]], k: int):
    """Keeps rows that may be among the ``k`` highest scores inside one of the windows."""

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        stays = np.zeros(len(low), bool)
        for bottom, top in windows:
            sure = low[(low >= bottom) & (high <= top)]
            least = max(bottom, np.partition(sure, len(sure) - k)[len(sure) - k]) if len(sure) >= k else bottom
            stays |= (high >= least) & (low <= top)
        return stays

    return keep


def _positives(k: int):
    def work(block, chunk):
        out = []
        if block.num_rows and chunk.num_rows:
            cell = Block(block, chunk)
            anchors, keep = cell.anchors, best(k)
            for a, (i, tag, label) in enumerate(zip(anchors["ids"], anchors["tags"], anchors["labels"])):
                alive = (cell.labels == label) & ((cell.ids != i) | cell.missing)
                rows, score = cell.scan(a, alive, keep)
                out += [(i, tag, cell.given[rows[p]], int(score[p])) for p in cell.first(rows, score, k)]
        return _table(out, FOUND)

    return work


def _negatives(k: int, low: int, high: int):
    def work(block, chunk):
        out = []
        if block.num_rows and chunk.num_rows:
            cell = Block(block, chunk)
            anchors, owned = cell.anchors, {}
            for a, place, i, score in zip(*[anchors[c.split()[0]] for c in WINDOWS.split(", ")]):
                # low * positive <= 100 * negative <= high * positive, in whole numbers.
                owned.setdefault(a, []).append((place, i, score, -(-low * score // 100), high * score // 100))
            for a, positives in owned.items():
                i = anchors["ids"][a]
                alive = (cell.labels != anchors["labels"][a]) & ((cell.ids != i) | cell.missing)
                windows = sorted({p[3:] for p in positives if p[3] <= p[4]})
                rows, scores = cell.scan(a, alive, inside(windows, k)) if windows else (np.zeros(0, int), np.zeros(0, int))
                for place, positive, score, bottom, top in positives:
                    fit = np.flatnonzero((scores >= bottom) & (scores <= top))
                    out += [(i, anchors["tags"][a], place, positive, score, cell.given[rows[fit[p]]], int(scores[fit[p]]))
                            for p in cell.first(rows[fit], scores[fit], k)]
        return _table(out, MINED)

    return work


def _table(rows: list[tuple], schema: str) -> pa.Table:
    names = [c.split()[0] for c in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)


def _dealt(df: DataFrame, name: str, other: str, others: int, cells: int) -> DataFrame:
    """A packed table with a copy for every block (chunk) of the other side."""
    return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).repartition(cells, "block", "chunk")


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("vec_id", "tag"), F.lit(n)).cast("int")


def mine(rows: DataFrame, anchors: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LEAST, high: int = GREATEST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of a ``prepared`` table.

    Scores are inner products, higher first, ties by smaller id. An anchor's positives are its first ``positives`` rows
    of the same label; for each, the first ``negatives`` rows of other labels whose score is from ``low`` to ``high``
    percent of the positive's. ``anchors`` says which rows are anchors, by default those whose id 50 divides.
    """
    rows = written(rows, "vectors")
    anchors = (F.col("vec_id") % 50 == 0) if anchors is None else anchors
    n, m, dims = rows.agg(F.count("*"), F.count_if(anchors), F.max(F.size("x"))).first()
    dims = max(dims or 0, 1)
    n_blocks, n_chunks = max(1, -(-n * dims // BLOCK)), max(1, -(-m * dims // CHUNK))
    cells = n_blocks * n_chunks
    blocks = written(rows.withColumn("block", _bucket(n_blocks)).groupBy("block").applyInArrow(_pack_block, BLOCKS), "blocks")
    queries = rows.where(anchors & F.col("vec_id").isNotNull()).withColumn("chunk", _bucket(n_chunks))

    def scanned(chunks: DataFrame, work, schema: str) -> DataFrame:
        left = _dealt(blocks, "block", "chunk", n_chunks, cells).groupBy("block", "chunk")
        right = _dealt(chunks, "chunk", "block", n_blocks, cells).groupBy("block", "chunk")
        return left.cogroup(right).applyInArrow(work, schema)

    def ranked(found: DataFrame, keys: list[str], by: str, partner: str, k: int) -> DataFrame:
        order = Window.partitionBy("anchor_id", "tag", *keys).orderBy(F.desc(by), F.asc_nulls_last(partner))
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    found = scanned(queries.groupBy("chunk").applyInArrow(_pack_chunk, CHUNKS), _positives(positives), FOUND)
    found = ranked(found, [], "positive_score", "positive_id", positives)
    lists = found.groupBy("anchor_id", "tag").agg(
        F.collect_list(F.struct("rank", "positive_id", "positive_score")).alias("positives"))
    known = written(queries.join(lists, (queries["vec_id"] == lists["anchor_id"]) & (queries["tag"] == lists["tag"])).select(
        queries["*"], "positives"), "positives")
    mined = scanned(known.groupBy("chunk").applyInArrow(_pack_chunk, f"{CHUNKS}, {WINDOWS}"), _negatives(negatives, low, high),
                    MINED)
    return ranked(mined, ["place"], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
