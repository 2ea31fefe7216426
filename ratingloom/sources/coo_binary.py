"""Coordinate-format binary files as a Spark data source.

Little-endian: a header ``users, items, records`` and then 12-byte records
``user, item, rating``. The record count takes 4 bytes (layout ``narrow``) or 8 (``wide``).
Records have a fixed size, so a file is cut into byte ranges that tasks read on their own,
and a record's position follows from its offset. A filter on ``rec_id`` bounds leaves ranges
outside unread.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual,
                                    InputPartition, LessThan, LessThanOrEqual)

# Fixed values of the file format.
RECORD_BYTES = 12
HEADERS = {"narrow": "<u4,<u4,<u4", "wide": "<u4,<u4,<u8"}
HEADER_BYTES = {"narrow": 12, "wide": 16}

DEFAULT_RANGE_BYTES = 64 << 20
BATCH_RECORDS = 1 << 16


class ByteRange(InputPartition):
    """Records ``first .. first + count - 1`` of one file."""

    def __init__(self, path: str, first: int, count: int, rec_id: int, header: tuple[int, int, int]):
        self.path = path
        self.first = first
        self.count = count
        self.rec_id = rec_id
        self.header = header


def open_path(path: str):
    """File system and plain path for a URI or a local path; works on every executor."""
    from pyarrow import fs
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


def _files(path: str) -> list[str]:
    from pyarrow import fs
    system, plain = open_path(path)
    info = system.get_file_info(plain)
    if info.type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(plain))
        names = sorted(f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
    elif info.type == fs.FileType.File:
        names = [plain]
    else:
        raise FileNotFoundError(path)
    prefix = path.split(plain)[0] if "://" in path else ""
    return [prefix + name for name in names]


class CooBinaryReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.layout = options.get("layout", "narrow")
        self.range_bytes = int(options.get("rangeBytes", DEFAULT_RANGE_BYTES))
        self.what = options.get("what", "records")
        # Records wanted, by number; filters narrow this.
        self.first, self.end = 0, 1 << 63
        if self.layout not in HEADERS:
            raise ValueError(f"layout must be one of {sorted(HEADERS)}, not {self.layout!r}")

    def pushFilters(self, filters):
        """Take over bounds of ``rec_id``; other filters stay with Spark."""
        for given in filters:
            bounds = self._bounds(given)
            if bounds is None:
                yield given
            else:
                self.first, self.end = max(self.first, bounds[0]), min(self.end, bounds[1])

    @staticmethod
    def _bounds(given) -> tuple[int, int] | None:
        """First and end of the record numbers that a filter lets through."""
        if getattr(given, "attribute", None) != ("rec_id",) or not isinstance(getattr(given, "value", None), int):
            return None
        n, all_of = given.value, (0, 1 << 63)
        return {EqualTo: (n, n + 1), GreaterThan: (n + 1, all_of[1]), GreaterThanOrEqual: (n, all_of[1]),
                LessThan: (0, n), LessThanOrEqual: (0, n + 1)}.get(type(given))

    def _header(self, path: str) -> tuple[int, int, int]:
        import numpy as np
        system, plain = open_path(path)
        size = HEADER_BYTES[self.layout]
        with system.open_input_file(plain) as file:
            raw = file.read(size)
        if len(raw) < size:
            raise ValueError(f"{path}: shorter than its header")
        users, items, records = np.frombuffer(raw, dtype=HEADERS[self.layout])[0]
        return int(users), int(items), int(records)

    def partitions(self):
        ranges = []
        start = 0
        step = max(1, self.range_bytes // RECORD_BYTES)
        for path in _files(self.path):
            header = self._header(path)
            records = header[2]
            if self.what == "header":
                ranges.append(ByteRange(path, 0, 0, start, header))
            else:
                begin, end = max(0, self.first - start), min(records, self.end - start)
                ranges += [ByteRange(path, first, min(step, end - first), start + first, header)
                           for first in range(begin, end, step)]
            start += records
        return ranges or [ByteRange(self.path, 0, 0, 0, (0, 0, 0))]

    def read(self, partition):
        import numpy as np
        import pyarrow as pa
        if self.what == "header":
            users, items, records = partition.header
            yield pa.RecordBatch.from_arrays(
                [pa.array([partition.path]), pa.array([users], pa.int64()), pa.array([items], pa.int64()),
                 pa.array([records], pa.int64())], names=["file", "num_users", "num_items", "num_records"])
            return
        system, plain = open_path(partition.path)
        if partition.count == 0:
            return
        with system.open_input_file(plain) as file:
            for first in range(0, partition.count, BATCH_RECORDS):
                count = min(BATCH_RECORDS, partition.count - first)
                offset = HEADER_BYTES[self.layout] + (partition.first + first) * RECORD_BYTES
                raw = file.read_at(count * RECORD_BYTES, offset)
                whole = len(raw) // RECORD_BYTES
                records = np.frombuffer(raw, dtype="<u4,<u4,<f4", count=whole)
                rec_id = partition.rec_id + first + np.arange(whole, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rec_id), pa.array(records["f0"].astype(np.int64)),
                     pa.array(records["f1"].astype(np.int64)), pa.array(records["f2"].astype(np.float32))],
                    names=["rec_id", "user_id", "item_id", "rating"])
                if whole < count:
                    return  # the file ends early; check_ratings compares the counts


class CooBinarySource(DataSource):
    """``spark.read.format('coo_binary').option('layout', 'narrow' | 'wide')``."""

    @classmethod
    def name(cls) -> str:
        return "coo_binary"

    def schema(self) -> str:
        if self.options.get("what") == "header":
            return "file string, num_users long, num_items long, num_records long"
        return "rec_id long, user_id long, item_id long, rating float"

    def reader(self, schema) -> CooBinaryReader:
        return CooBinaryReader(self.options)  # keys are case-insensitive


def _load(spark: SparkSession, path: str, layout: str, what: str, range_bytes: int) -> DataFrame:
    import sys
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(CooBinarySource)
    # Spark asks Python sources for filters only where this is set.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return (spark.read.format("coo_binary").option("layout", layout).option("what", what)
            .option("rangeBytes", str(range_bytes)).load(path))


def read_coo_binary(spark: SparkSession, path: str, layout: str = "narrow", id_base: int | None = None,
                    range_bytes: int = DEFAULT_RANGE_BYTES) -> DataFrame:
    """``(rec_id, user_id, item_id, rating)`` in file order; ids shifted to start at 0.

    Ids count from 0 in the narrow layout and from 1 in the wide one, unless ``id_base`` says otherwise.
    """
    from ratingloom.operators.profiles import rebase_ids
    base = id_base if id_base is not None else {"narrow": 0, "wide": 1}.get(layout, 0)
    return rebase_ids(_load(spark, path, layout, "records", range_bytes), base)


def read_header(spark: SparkSession, path: str, layout: str = "narrow") -> DataFrame:
    """``(file, num_users, num_items, num_records)``, one row per file."""
    return _load(spark, path, layout, "header", DEFAULT_RANGE_BYTES)
