"""Files written by tasks and shown by the driver: all of them, or none.

A task writes its rows to a file under a hidden folder. When all tasks are done the driver moves the files
of the attempts that counted to their places, in the order of the tasks; if one fails, or the job ends early,
the hidden folder goes and nothing else was touched. ``single`` gives one named file, written by one task.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ratingloom.sources.coo_binary import open_path


@dataclass
class WrittenFile(WriterCommitMessage):
    """What one task wrote; no name if it had no rows."""

    partition: int
    name: str | None
    rows: int


class PartFileWriter(DataSourceArrowWriter):
    """Writes the batches of each task by ``body`` and ``head`` of a subclass."""

    suffix = ""

    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.single = options.get("single", "false").lower() == "true"
        folder, _, name = self.path.rpartition("/")
        self.hidden = f"{folder}/.{name}-{uuid.uuid4().hex}"
        # Made once, by the driver: a task that outlives a failed job finds no place to write to.
        system, hidden = open_path(self.hidden)
        system.create_dir(hidden)

    def body(self, batch) -> bytes:
        raise NotImplementedError

    def head(self, rows: int) -> bytes:
        """What stands before the rows, known when all are written."""
        return b""

    def write(self, iterator) -> WrittenFile:
        context = TaskContext.get()
        system, folder = open_path(self.hidden)
        name = f"{context.partitionId():05d}-{context.taskAttemptId()}"
        rows = 0
        with system.open_output_stream(f"{folder}/{name}.body") as out:
            for batch in iterator:
                rows += batch.num_rows
                out.write(self.body(batch))
        head = self.head(rows)
        if not head:
            system.move(f"{folder}/{name}.body", f"{folder}/{name}")
        else:
            with system.open_output_stream(f"{folder}/{name}") as out, system.open_input_stream(f"{folder}/{name}.body") as body:
                out.write(head)
                while data := body.read(1 << 20):
                    out.write(data)
            system.delete_file(f"{folder}/{name}.body")
        return WrittenFile(context.partitionId(), name if rows or self.single else None, rows)

    def commit(self, messages) -> None:
        system, folder = open_path(self.hidden)
        target = open_path(self.path)[1]
        files = sorted((m for m in messages if m is not None and m.name), key=lambda m: m.partition)
        try:
            if self.single:
                if len(files) != 1:
                    raise ValueError(f"one file needs one task, not {len(files)}")
                system.move(f"{folder}/{files[0].name}", target)
                return
            system.create_dir(target)
            for number, file in enumerate(files):
                system.move(f"{folder}/{file.name}", f"{target}/part-{number:05d}{self.suffix}")
        finally:
            self.abort(messages)

    def abort(self, messages) -> None:
        from pyarrow import fs
        system, folder = open_path(self.hidden)
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


class CooBinaryWriter(PartFileWriter):
    """Coordinate binary files of rows ``user_id, item_id, rating``; every file has a header with its own count."""

    suffix = ".bin"

    def __init__(self, options):
        super().__init__(options)
        self.layout = options.get("layout", "narrow")
        self.id_base = int(options.get("idBase", {"narrow": 0, "wide": 1}[self.layout]))
        self.sizes = int(options["numUsers"]), int(options["numItems"])

    def head(self, rows: int) -> bytes:
        import numpy as np
        from ratingloom.sources.coo_binary import HEADERS
        return np.array([(*self.sizes, rows)], dtype=HEADERS[self.layout]).tobytes()

    def body(self, batch) -> bytes:
        import numpy as np
        records = np.zeros(batch.num_rows, dtype="<u4,<u4,<f4")
        records["f0"] = batch.column("user_id").to_numpy() + self.id_base
        records["f1"] = batch.column("item_id").to_numpy() + self.id_base
        records["f2"] = batch.column("rating").to_numpy()
        return records.tobytes()


class LineWriter(PartFileWriter):
    """Text files of rows ``value``, a line each."""

    suffix = ".txt"

    def body(self, batch) -> bytes:
        return "".join(f"{line}\n" for line in batch.column("value").to_pylist()).encode()


class CooBinarySink(DataSource):
    """``df.write.format('coo_binary_files').option('numUsers', ...).option('numItems', ...)``."""

    @classmethod
    def name(cls) -> str:
        return "coo_binary_files"

    def writer(self, schema, overwrite: bool) -> CooBinaryWriter:
        return CooBinaryWriter(self.options)


class LineSink(DataSource):
    """``df.write.format('line_files')``, with ``option('single', 'true')`` for one named file."""

    @classmethod
    def name(cls) -> str:
        return "line_files"

    def writer(self, schema, overwrite: bool) -> LineWriter:
        return LineWriter(self.options)


def register(spark) -> None:
    """Make the sinks known to a session; their code travels with the jobs."""
    import sys
    from pyspark import cloudpickle
    from ratingloom.sources import coo_binary
    for module in (sys.modules[__name__], coo_binary):
        cloudpickle.register_pickle_by_value(module)
    for sink in (CooBinarySink, LineSink):
        spark.dataSource.register(sink)
