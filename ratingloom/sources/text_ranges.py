"""Lines of text files by fixed byte ranges, as a Spark data source.

A line belongs to the range that holds its first byte, so ranges are read on their own, whatever the length
of a line, and the same range always gives the same lines. Reading the files again replaces a written copy.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ratingloom.sources import coo_binary
from ratingloom.sources.coo_binary import open_path

DEFAULT_RANGE_BYTES = 64 << 20
CHUNK_BYTES = 1 << 20
#: Names of packed files and of patterns, which only Spark's own reader takes.
PACKED = (".gz", ".bz2", ".zst", ".snappy", ".lz4", ".deflate", ".xz")
PATTERN = set("*?[]{}")


class LineRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path = path
        self.start = start
        self.end = end


def lines_between(file, start: int, end: int):
    """Lists of the lines that begin at bytes ``start`` to ``end - 1``; line feeds and returns end a line."""
    at, rest, begun = max(0, start - 1), b"", start == 0
    place = at  # of the first byte of ``rest``
    while place < end:
        chunk = file.read_at(CHUNK_BYTES, at)
        at += len(chunk)
        data = rest + chunk.replace(b"\r", b"\n")
        if not begun:
            cut = data.find(b"\n")
            if cut < 0 and chunk:
                place, rest = place + len(data), b""
                continue
            place, data, begun = place + (cut + 1 if cut >= 0 else len(data)), data[cut + 1:] if cut >= 0 else b"", True
            if place >= end:
                return
        if not chunk:
            if data:
                yield [data]
            return
        whole = data.rfind(b"\n") + 1
        lines, rest = data[:whole], data[whole:]
        beyond = end - place
        if len(lines) >= beyond:
            # The last line that begins before the end; one that is not whole yet is read on.
            stop = lines.find(b"\n", beyond - 1) + 1 if beyond > 0 else 0
            if stop:
                yield lines[:stop].split(b"\n")[:-1]
                return
        if lines:
            yield lines.split(b"\n")[:-1]
        place += len(lines)


class TextRangeReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangeBytes", DEFAULT_RANGE_BYTES))

    def partitions(self):
        ranges = []
        for path in coo_binary._files(self.path):
            system, plain = open_path(path)
            size = system.get_file_info(plain).size
            ranges += [LineRange(path, start, min(size, start + self.range_bytes))
                       for start in range(0, size, self.range_bytes)]
        return ranges or [LineRange(self.path, 0, 0)]

    def read(self, partition):
        import pyarrow as pa
        import pyarrow.compute as pc
        if partition.start == partition.end:
            return
        system, plain = open_path(partition.path)
        number = 0
        with system.open_input_file(plain) as file:
            for lines in lines_between(file, partition.start, partition.end):
                values = pa.array([line.decode("utf-8", "replace") for line in lines], pa.string())
                blank = pc.equal(pc.binary_length(pc.ascii_trim_whitespace(values)), 0)
                values = values.filter(pc.invert(pc.or_(blank, pc.starts_with(values, "%"))))
                count = len(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.path] * count, pa.string()), pa.array([partition.start] * count, pa.int64()),
                     pa.array(range(number, number + count), pa.int64()), values], names=["file", "block", "line_id", "value"])
                number += count


class TextRangeSource(DataSource):
    """``(file, block, line_id, value)``: lines but comments and blank ones, numbered inside their range."""

    @classmethod
    def name(cls) -> str:
        return "text_ranges"

    def schema(self) -> str:
        return "file string, block long, line_id long, value string"

    def reader(self, schema) -> TextRangeReader:
        return TextRangeReader(self.options)


def reachable(path: str) -> bool:
    """Whether tasks can open the files themselves."""
    from pyarrow import fs
    try:
        if PATTERN & set(path):
            return False
        system, plain = open_path(path)
        if system.get_file_info(plain).type == fs.FileType.NotFound:
            return False
        return not any(name.endswith(PACKED) for name in coo_binary._files(path))
    except Exception:  # a store that Arrow does not know; Spark may
        return False


def read_lines(spark: SparkSession, path: str, range_bytes: int = DEFAULT_RANGE_BYTES) -> DataFrame:
    import sys
    for module in (sys.modules[__name__], coo_binary):
        cloudpickle.register_pickle_by_value(module)
    spark.dataSource.register(TextRangeSource)
    return spark.read.format("text_ranges").option("rangeBytes", str(range_bytes)).load(path)
