"""Token ids in files: fixed-width bit packing, in document order.

A store is a folder of two tables, written and read by Spark wherever it lives:

``blocks``  one row a block: ``shard, block, width, n_ids, doc_ids, offsets, packed``
``shards``  one row a shard: ``shard, base, n_ids``

A shard is a range of document ids, a block a run of whole documents of it (one block for
a document longer than a block). Id ``i`` of a block stands in bits ``i * width`` to
``(i + 1) * width`` of ``packed``, least bit first, ``width`` being the bits of the largest
id of the vocabulary. ``offsets`` has the first id of each document in the block, and the
number of ids at its end, so that any document or id is found without unpacking the rest,
and a whole block is unpacked by numpy at once. ``base`` is the number of ids in all
shards before, so ``base`` + ids of earlier blocks + offset is a document's global start.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratingloom.llm.tables import documents, slices
from ratingloom.llm.token_ids import SLICE_BYTES, encoder

#: Ids after which a block is closed.
BLOCK_IDS = 1 << 16
BLOCKS = "shard int, block int, start long, width int, n_ids long, doc_ids array<long>, offsets array<long>, packed binary"


def width_of(vocabulary: int) -> int:
    """Fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as consecutive ``width``-bit numbers, least bit first."""
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    if width in (8, 16, 32):  # the same bits, without spreading them
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def unpack(packed: bytes, width: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from id ``first`` on; only the bytes that hold them are touched."""
    if width in (8, 16, 32):
        return np.frombuffer(packed, f"<u{width // 8}", count, first * width // 8).astype(np.uint32)
    low, high = first * width // 8, -(-(first + count) * width // 8)
    bits = np.unpackbits(np.frombuffer(packed, np.uint8, high - low, low), bitorder="little")
    skip = first * width - low * 8
    bits = bits[skip: skip + count * width].reshape(count, width).astype(np.uint32)
    return bits @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 0, doc_id: str = "doc_id",
                 text: str = "text") -> None:
    """Encode whole texts, each followed by id ``end``, and write them in ascending id order.

    Null and empty texts are the end id alone. Rows that share an id follow each other by
    text; rows with a null id come first and keep a null id. An empty table gives an empty
    store. Other columns are not looked at.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        shard = TaskContext.get().partitionId()
        encode = encoder(tokenizer)
        width = width_of(max(encode.vocabulary, end + 1))
        names: list = []
        parts: list[np.ndarray] = []
        offsets, filled, block, written = [0], 0, 0, 0

        def close():
            return pa.record_batch({
                "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()),
                "start": pa.array([written], pa.int64()), "width": pa.array([width], pa.int32()),
                "n_ids": pa.array([filled], pa.int64()), "doc_ids": pa.array([names], pa.list_(pa.int64())),
                "offsets": pa.array([offsets], pa.list_(pa.int64())),
                "packed": pa.array([pack(np.concatenate(parts), width)], pa.binary())})

        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                ids, firsts = encode.encode(part.column("text"), end)
                for name, low, high in zip(part.column("doc_id").to_pylist(), firsts[:-1], firsts[1:]):
                    if names and filled + high - low > BLOCK_IDS:
                        yield close()
                        written, block = written + filled, block + 1
                        names, parts, offsets, filled = [], [], [0], 0
                    names.append(name)
                    parts.append(ids[low:high])
                    filled += int(high - low)
                    offsets.append(filled)
        if names:
            yield close()
        encode.rest()

    rows = documents(docs, doc_id, text).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    ordered.mapInArrow(run, BLOCKS).write.parquet(f"{path}/blocks")
    blocks = docs.sparkSession.read.schema(BLOCKS).parquet(f"{path}/blocks")
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    # One row a written shard: one task adds them up.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"),
                 "n_ids").write.parquet(f"{path}/shards")


def _opened(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with their global first id."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    shards = spark.read.schema("shard int, base long, n_ids long").parquet(f"{path}/shards").drop("n_ids")
    # As many rows as tasks wrote the store, 12 bytes each: a bound that does not grow with the documents.
    return blocks.join(F.broadcast(shards), "shard").withColumn("first", F.col("base") + F.col("start"))


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document in the store, and its ``ids`` if wanted."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in range(batch.num_rows):
                width, first, packed, names, offsets = (batch.column(c)[row] for c in (
                    "width", "first", "packed", "doc_ids", "offsets"))
                offsets = offsets.values.to_numpy()
                ids = unpack(packed.as_buffer(), width.as_py(), 0, int(offsets[-1])).astype("<u4")
                columns = {
                    "doc_id": names.values.cast(pa.int64()),
                    "start": pa.array(first.as_py() + offsets[:-1]),
                    "n_tokens": pa.array(np.diff(offsets)),
                    "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], pa.int64())}
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(
                        pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32), pa.int32()))
                yield pa.record_batch(columns)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    columns = _opened(spark, path).select("width", "first", "packed", "doc_ids", "offsets")
    return columns.mapInArrow(run, schema)


def read_ids(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """``(position, id)`` of the global ids ``low`` to ``high`` (end exclusive); other blocks are skipped."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in batch.to_pylist():
                a, b = max(low, row["first"]), min(high, row["first"] + row["n_ids"])
                ids = unpack(row["packed"], row["width"], a - row["first"], b - a)
                yield pa.record_batch({"position": pa.array(np.arange(a, b)), "id": pa.array(ids.astype(np.int64))})

    held = _opened(spark, path).where((F.col("first") < high) & (F.col("first") + F.col("n_ids") > low))
    return held.select("width", "first", "n_ids", "packed").mapInArrow(run, "position long, id long")
