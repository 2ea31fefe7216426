"""Best-fit packing of documents into sequences of a fixed capacity.

Pieces are put in order of length and, inside a length, in order of a rank; gaps are put in
order of size, bins of one gap being numbered in a row, so that a run of equal gaps is one
entry (gap, first bin, number of bins). A sweep takes the lengths from the largest down.
The successor of a length is the smallest gap that holds it; pieces that want the same gap
get its bins in the order of their ranks, as many to a bin as best fit would put there, and
what a run can not hold goes on to the next larger gap, then to new bins. Then the gaps are
updated and the sweep goes on.

Ranks are counted by Spark over all pieces and each piece looks up its own bin. The sweep
itself only sees how many pieces have each length, so its work and the table that executors
receive are bounded by the capacity, whatever the number of documents.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingloom.llm.tables import documents, slices
from ratingloom.llm.token_ids import SLICE_BYTES, encoder
from ratingloom.session import stage

CAPACITY = 2048


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document: whole ones, the first one shorter if need be."""
    first = length % capacity or min(length, capacity)
    return [(0, first)] + [(start, capacity) for start in range(first, length, capacity)]


def sweep(counts: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: runs of consecutive ranks on consecutive bins.

    ``counts[n]`` pieces have length n. In a run, piece ``rank`` goes to bin
    ``bin + (rank - low) // each`` at offset ``offset + (rank - low) % each * length``.
    """
    gaps: list[tuple[int, int, int]] = []  # (gap, first bin, bins), ascending
    runs: list[tuple[int, int, int, int, int]] = []
    bins = 0
    for length in range(capacity, 0, -1):
        low, left = 0, int(counts[length])
        while left:
            at = bisect_left(gaps, (length, 0, 0))
            if at < len(gaps):
                gap, first, many = gaps.pop(at)
            else:
                gap, first, many = capacity, bins, -(-left // (capacity // length))
                bins += many
            each = gap // length
            used = min(many, -(-left // each))
            placed = min(left, used * each)
            runs.append((length, low, first, each, capacity - gap))
            full, rest = divmod(placed, each)
            for size, start, number in ((gap - each * length, first, full),
                                        (gap - rest * length, first + full, int(rest > 0)),
                                        (gap, first + used, many - used)):
                if number and size:
                    insort(gaps, (size, start, number))
            low, left = low + placed, left - placed
    table = np.array(runs, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return dict(zip(("length", "low", "bin", "each", "offset"), table.T))


def token_pieces(docs: DataFrame, tokenizer: str, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, part, nth)``; ``nth`` counts a length inside its task."""
    def run(batches: Iterator[pa.RecordBatch]):
        encode = encoder(tokenizer)
        part_id = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                ids, firsts = encode.encode(part.column("text"), end)
                ids = ids.astype("<u4")
                rows = []
                for name, low, high in zip(part.column("doc_id").to_pylist(), firsts[:-1].tolist(),
                                           firsts[1:].tolist()):
                    for piece, (start, length) in enumerate(cut(high - low, capacity)):
                        crc = zlib.crc32(ids[low + start: low + start + length])
                        rows.append((name, piece, start, length, crc, part_id, seen[length]))
                        seen[length] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth")
                yield pa.record_batch({n: pa.array(c, k) for n, c, k in zip(names, zip(*rows), kinds)})
        encode.rest()

    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a stored table of pieces with ``part`` and ``nth``."""
    spark = pieces.sparkSession
    counted = stage(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stage(counted.df.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")),
                  "bases")
    totals = counted.df.groupBy("length").agg(F.sum("n").alias("n")).toArrow()  # at most one row a length
    counts = np.zeros(capacity + 1, np.int64)
    counts[totals.column("length").to_numpy()] = totals.column("n").to_numpy()
    counted.drop()
    shared = spark.sparkContext.broadcast(sweep(counts, capacity))

    def run(batches: Iterator[pa.RecordBatch]):
        table = shared.value
        firsts = np.searchsorted(table["length"], np.arange(capacity + 2))
        # Runs of a length follow each other by rank; a length times a large step makes one sorted key.
        step = np.int64(1) << 50
        keys = table["length"] * step + table["low"]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            row = np.searchsorted(keys, length * step + rank, side="right") - 1
            assert (row >= firsts[length]).all()
            past = rank - table["low"][row]
            each = table["each"][row]
            columns = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            columns["sequence_id"] = pa.array(table["bin"][row] + past // each)
            columns["offset"] = pa.array(table["offset"][row] + past % each * length)
            yield pa.record_batch(columns)

    ranked = pieces.join(bases.df, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    return ranked.drop("part", "nth", "base").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end: int = 0, capacity: int = CAPACITY, doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """Pack whole documents: one row a piece with its ``sequence_id`` and gapless ``offset``.

    Each document is its ids and the id ``end``; null and empty texts are the end id alone.
    Only documents of more than ``capacity`` ids are cut. Repeated rows are packed as often
    as they come, null ids stay null, and an empty table gives an empty table. Other columns
    are not looked at.
    """
    pieces = stage(token_pieces(documents(docs, doc_id, text), tokenizer, end, capacity), "pieces")
    return pack_pieces(pieces.df, capacity)
