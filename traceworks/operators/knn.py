"""Exact nearest neighbours: blocks of query vectors against blocks of a collection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Vectors in one block of queries and in one block of the collection, on average.
QUERY_BLOCK, BASE_BLOCK = 512, 20_000
CANDIDATES = "query_id long, collection string, doc_id long, distance double"


def _nearest(k: int):
    """The k nearest per query and collection inside one pair of blocks (two Arrow tables to one)."""

    def work(queries, base):
        out = {"query_id": [], "collection": [], "doc_id": [], "distance": []}
        if queries.num_rows and base.num_rows:
            ids = queries.column("query_id").to_numpy()
            matrix = np.array(queries.column("query_vector").to_pylist(), np.float64)
            norms = (matrix ** 2).sum(axis=1)
            rows = np.array(base.column("vector").to_pylist(), np.float64)
            groups = np.asarray(base.column("collection").to_pylist(), dtype=object)
            keys = base.column("doc_id").to_numpy()
            for group in set(groups):
                at = np.flatnonzero(groups == group)
                part = rows[at]
                # Shortlist by the expanded form, then exact differences for it.
                rough = norms[:, None] - 2 * matrix @ part.T + (part ** 2).sum(axis=1)[None, :]
                keep = min(k, len(at))
                for q in range(len(ids)):
                    limit = np.partition(rough[q], keep - 1)[keep - 1]
                    near = np.flatnonzero(rough[q] <= limit + 1e-9 * (1 + abs(limit)))
                    dist = ((part[near] - matrix[q]) ** 2).sum(axis=1)
                    best = np.lexsort((keys[at[near]], dist))[:keep]
                    out["query_id"] += [ids[q]] * len(best)
                    out["collection"] += [group] * len(best)
                    out["doc_id"] += keys[at[near[best]]].tolist()
                    out["distance"] += dist[best].tolist()
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.float64())
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds)})

    return work


def nearest_per_collection(base: DataFrame, queries: DataFrame, k: int, query_block: int = QUERY_BLOCK,
                           base_block: int = BASE_BLOCK) -> DataFrame:
    """(query_id, collection, doc_id, distance): the k nearest of every collection per query.

    ``base`` has doc_id, collection and vector; ``queries`` query_id and query_vector. Distance is squared L2. Both
    sides are cut into blocks by hash; every pair of blocks is one task's bounded work, and only its k best go on. No
    vector passes through the driver.
    """
    n_queries = max(1, -(-queries.count() // query_block))
    n_base = max(1, -(-base.count() // base_block))

    def dealt(df: DataFrame, key: str, own: str, blocks: int, other: str, others: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    left = dealt(queries.select(F.col("query_id").cast("long").alias("query_id"), "query_vector"), "query_id", "qb",
                 n_queries, "bb", n_base)
    right = dealt(base.select(F.col("doc_id").cast("long").alias("doc_id"), "collection", "vector"), "doc_id", "bb",
                  n_base, "qb", n_queries)
    found = left.groupBy("qb", "bb").cogroup(right.groupBy("qb", "bb")).applyInArrow(_nearest(k), CANDIDATES)
    order = Window.partitionBy("query_id", "collection").orderBy("distance", "doc_id")
    return found.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k).drop("_rn")


def nearest_neighbours(base: DataFrame, queries: DataFrame, k: int, query_block: int = QUERY_BLOCK,
                       base_block: int = BASE_BLOCK) -> DataFrame:
    """(query_id, doc_id, collection, distance, rank): the k nearest overall per query; ties by id, then collection."""
    overall = Window.partitionBy("query_id").orderBy("distance", "doc_id", "collection")
    return nearest_per_collection(base, queries, k, query_block, base_block).withColumn(
        "rank", F.row_number().over(overall)).where(F.col("rank") <= k)
