"""What stateful streams share: the state store they need, and rows combined in a task before they reach the state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Processors with processing-time timers ask for another batch for ever; state ends with the next batch of data instead.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, as processors with timers and expiry need; others don't."""
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def combined(rows: DataFrame, keys: list[str], parts: list[tuple[str, str]], schema: str,
             packed: Callable[[pa.Table], pa.Table] | None = None) -> DataFrame:
    """Rows of a stream aggregated batch by batch inside every task, so that a busy key is a few rows.

    ``parts`` are (column, Arrow aggregate); the result has the keys, then one column ``<column>_<aggregate>`` each, in
    the types of ``schema``, or what ``packed`` makes of these. Keeps no state.
    """
    names = [*keys, *[f"{c}_{how}" for c, how in parts]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch]).group_by(keys).aggregate(parts)
                table = table.select(names)
                yield from (packed(table) if packed else table).to_batches()

    return rows.mapInArrow(work, schema)


Report = Callable[[DataFrame, int], None]


def into_batches(path: str) -> Report:
    """A sink with one folder per batch; a batch that is run again overwrites its own folder."""

    def store(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return store
