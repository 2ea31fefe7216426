"""Factor tables as text: one row per line in id order, ``%10.2g`` and a blank per value."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.functions.number_text import general_format
from ratingloom.sources import part_files

# Fixed values of the text format.
DIGITS, WIDTH = 2, 10


def factor_lines(factors: DataFrame) -> DataFrame:
    """``(id, line)`` for ``(id, features)``."""
    values = F.transform("features", lambda x: F.concat(general_format(x, DIGITS, WIDTH), F.lit(" ")))
    return factors.select("id", F.array_join(values, "").alias("line"))


def write_factor_text(factors: DataFrame, folder: str, name: str, when: datetime | None = None,
                      single: bool = False) -> str:
    """Write ``<folder>/<name>-<mon>-<day>-<h>-<m>-<s>.txt`` (month counted from 0).

    The path is a folder of files whose order is the id order or, with ``single``, one file that one task writes.
    Either appears whole, when all tasks are done.
    """
    moment = when or datetime.now()
    parts = (moment.month - 1, moment.day, moment.hour, moment.minute, moment.second)
    path = f"{folder}/{name}-" + "-".join(f"{p:02d}" for p in parts) + ".txt"
    part_files.register(factors.sparkSession)
    rows = factor_lines(factors)
    rows = rows.coalesce(1) if single else rows.repartitionByRange("id")
    lines = rows.sortWithinPartitions("id").select(F.col("line").alias("value"))
    lines.write.format("line_files").mode("append").option("single", str(single).lower()).save(path)
    return path
