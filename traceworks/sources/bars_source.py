"""Pluggable price-bar readers behind one Spark data source, for batches and streams."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    LessThan, LessThanOrEqual,
)

BAR_SCHEMA = ("ticker string, tf string, ts timestamp_ntz, open double, high double, low double, close double, "
              "volume bigint")
#: A file is split into ranges of so many bytes; a row group belongs to the range that its middle lies in.
RANGE_BYTES = 64 << 20
SUFFIXES = (".parquet", ".csv")


def opened(path: str):
    """(file system, path on it) of a plain path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[int, str, int]]:
    """(modified in ns, path, size) of every bar file below a folder, in order."""
    from pyarrow import fs

    system, root = opened(path)
    infos = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((i.mtime_ns or 0, i.path, i.size) for i in infos
                  if i.is_file and i.path.endswith(SUFFIXES) and not i.base_name.startswith((".", "_")))


def _may_hold(low, high, test: tuple[str, str, object]) -> bool:
    """Whether values from ``low`` to ``high`` can meet a test (operator, column, value)."""
    how, _, value = test
    if how == "in":
        return any(low <= v <= high for v in value)
    return {"=": lambda: low <= value <= high, "<": lambda: low < value, "<=": lambda: low <= value,
            ">": lambda: high > value, ">=": lambda: high >= value}[how]()


def row_groups(file, start: int, stop: int, tests: list[tuple[str, str, object]]) -> list[int]:
    """Row groups of a Parquet file whose middle lies in the byte range and that may hold rows meeting all tests."""
    meta = file.metadata
    place = {meta.schema.column(j).path: j for j in range(meta.num_columns)}
    chosen = []
    for k in range(meta.num_row_groups):
        group = meta.row_group(k)
        columns = [group.column(j) for j in range(group.num_columns)]
        first = min(c.dictionary_page_offset or c.data_page_offset for c in columns)
        middle = first + sum(c.total_compressed_size for c in columns) // 2
        stats = {test[1]: group.column(place[test[1]]).statistics for test in tests if test[1] in place}
        if start <= middle < stop and all(
                s is None or not s.has_min_max or _may_hold(s.min, s.max, test)
                for test in tests if test[1] in stats for s in (stats[test[1]],)):
            chosen.append(k)
    return chosen


def parquet_provider(system, path: str, columns: list[str], start: int, stop: int, tests: list):
    """Record batches of one range of a Parquet file; row groups that the tests rule out are not read."""
    import pyarrow.parquet as pq

    with system.open_input_file(path) as source:
        file = pq.ParquetFile(source)
        groups = row_groups(file, start, stop, tests)
        if groups:
            yield from file.iter_batches(row_groups=groups, columns=columns)


def csv_provider(system, path: str, columns: list[str], start: int, stop: int, tests: list):
    """Record batches of one CSV file, whole, as the task that has its start."""
    import pyarrow.dataset as ds

    if start == 0:
        yield from ds.dataset(path, format="csv", filesystem=system).to_batches(columns=columns)


# Readers by name; an unknown name falls back to the first.
PROVIDERS = {"parquet": parquet_provider, "csv": csv_provider}


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class _Bars:
    """What batch and stream readers share."""

    def __init__(self, options, columns: list[str]):
        self.path, self.provider, self.columns = options["path"], options.get("provider", "parquet"), columns
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.tests: list[tuple[str, str, object]] = []

    def ranges(self, files: list[tuple[int, str, int]]) -> list[_Range]:
        return [_Range(path, start, min(start + self.range_bytes, size) if start + self.range_bytes < size else 1 << 62)
                for _, path, size in files for start in range(0, max(size, 1), self.range_bytes)]

    def batches(self, partition: _Range):
        import pyarrow as pa

        provider = PROVIDERS.get(self.provider, PROVIDERS["parquet"])
        types = {"ts": pa.timestamp("us"), "volume": pa.int64(), "ticker": pa.string(), "tf": pa.string()}
        schema = pa.schema([(c, types.get(c, pa.float64())) for c in self.columns])
        system, _ = opened(self.path)
        for batch in provider(system, partition.path, self.columns, partition.start, partition.stop, self.tests):
            yield from pa.Table.from_batches([batch]).cast(schema).to_batches()


class _BarReader(_Bars, DataSourceReader):
    def pushFilters(self, filters):
        """Remember what row-group statistics can decide; Spark still applies every filter to the rows."""
        signs = {EqualTo: "=", LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">="}
        for f in filters:
            if len(getattr(f, "attribute", ())) == 1:
                if type(f) in signs and f.value is not None:
                    self.tests.append((signs[type(f)], f.attribute[0], f.value))
                elif isinstance(f, In):
                    self.tests.append(("in", f.attribute[0], [v for v in f.value if v is not None]))
            yield f

    def partitions(self):
        return self.ranges(listed(self.path))

    def read(self, partition):
        yield from self.batches(partition)


class _BarStream(_Bars, DataSourceStreamReader):
    """New files of the folder, in the order of their times; an offset is the last file seen."""

    def initialOffset(self):
        return {"at": -1, "path": ""}

    def latestOffset(self):
        files = listed(self.path)
        return {"at": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start, end):
        def place(offset):
            return offset["at"], offset["path"]

        return self.ranges([f for f in listed(self.path) if place(start) < f[:2] <= place(end)])

    def read(self, partition):
        yield from self.batches(partition)


class BarSource(DataSource):
    """``spark.read.format("bars").option("provider", name).load(folder)``, and the same with ``readStream``.

    The folder is a path or a URI. A task reads a range of a file; filters on columns skip row groups by their statistics.
    """

    @classmethod
    def name(cls):
        return "bars"

    def schema(self):
        return BAR_SCHEMA

    def reader(self, schema):
        return _BarReader(self.options, schema.fieldNames())

    def streamReader(self, schema):
        return _BarStream(self.options, schema.fieldNames())


def register(spark: SparkSession) -> None:
    """Make the format known; sources that take filters need them switched on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BarSource)
