"""A ledger of committed epochs, from which an interrupted run goes on.

A ledger folder holds the run's header, the tables of its layout and of its latest state, and one
small mark for each committed epoch. A mark is written beside its place and renamed, and it names the
table it commits, so a run that dies between two marks leaves only a table that nobody names; opening
the ledger again deletes it. One driver at a time writes to a ledger.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.functions.half_rows import unpacked
from ratingloom.session import Folder, StagedTable, stage


def fingerprint(ratings: DataFrame) -> dict:
    """Number and order-free checksum of the records, to notice other ratings under the same run."""
    value = F.pmod(F.xxhash64("rec_id", "user_id", "item_id", F.col("rating").cast("double")), F.lit((1 << 31) - 1))
    row = ratings.agg(F.count("*").alias("records"), F.coalesce(F.sum(value), F.lit(0)).alias("checksum")).first()
    return {"records": row.records, "checksum": row.checksum}


class EpochLedger:
    """The committed epochs of one run under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self._folder = Folder(spark, self.path)

    def open(self, header: dict) -> None:
        """Begin a run, or go on with it; another configuration or other ratings are refused.

        The number of epochs may differ, so that a finished run can be trained further.
        """
        header = json.loads(json.dumps(header))
        known = self._read("header")
        if known is None:
            self._write("header", header)
        elif known != header:
            changed = sorted(k for k in header.keys() | known.keys() if header.get(k) != known.get(k))
            raise ValueError(f"{self.path} belongs to a run with another {', '.join(changed)}")
        self._sweep()

    def commits(self) -> list[dict]:
        """The marks of all committed epochs, in order."""
        names = [n for n in self._folder.names("marks") if n.startswith("epoch-")]
        return [self._read(name[: -len(".json")]) for name in sorted(names)]

    def last(self) -> tuple[int, StagedTable] | None:
        """Number and state of the last committed epoch."""
        commits = self.commits()
        return (commits[-1]["epoch"], self.table(commits[-1]["state"])) if commits else None

    def commit(self, epoch: int, state: StagedTable, errors: dict, seconds: float | None) -> None:
        """Make ``state`` the result of ``epoch``; states before it are deleted afterwards."""
        earlier = self.last()
        self._write(f"epoch-{epoch:06d}", {"epoch": epoch, "state": self._name(state), "seconds": seconds, **errors})
        if earlier:
            earlier[1].drop()

    def layout(self) -> dict | None:
        """What ``keep_layout`` kept: names of tables, and values."""
        return self._read("layout")

    def keep_layout(self, values: dict, tables: dict[str, StagedTable | None]) -> None:
        self._write("layout", {"values": values, "tables": {k: t and self._name(t) for k, t in tables.items()}})

    def stage(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> StagedTable:
        return stage(df, name, partition_by, root=self.path)

    def table(self, name: str) -> StagedTable:
        path = f"{self.path}/ratingloom/{name}"
        df = self.spark.read.parquet(path)
        halves = [column for column, kind in df.dtypes if kind == "binary"]
        return StagedTable(unpacked(df, halves) if halves else df, path)

    def drop(self) -> None:
        self._folder.delete("")

    def _name(self, table: StagedTable) -> str:
        folder, name = table.path.rsplit("/", 1)
        if folder != f"{self.path}/ratingloom":
            raise ValueError(f"{table.path} was not staged in the ledger")
        return name

    def _sweep(self) -> None:
        """Delete tables that no mark names, or only the mark of an epoch that was followed by another."""
        layout = self.layout() or {"tables": {}}
        named = {t for t in layout["tables"].values() if t} | {c["state"] for c in self.commits()[-1:]}
        for name in self._folder.names("ratingloom"):
            if name not in named:
                self._folder.delete(f"ratingloom/{name}")

    def _read(self, mark: str) -> dict | None:
        text = self._folder.read(f"marks/{mark}.json")
        return None if text is None else json.loads(text)

    def _write(self, mark: str, values: dict) -> None:
        self._folder.write(f"marks/{mark}.json", json.dumps(values, sort_keys=True))
