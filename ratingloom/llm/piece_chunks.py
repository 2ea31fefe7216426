"""SentencePiece ids of whole texts by a table of distinct chunks.

A chunk is a run of whitespace markers with the characters up to the next marker. Where no piece
of the vocabulary holds a marker after another character, no merge crosses the end of a chunk, so
the ids of a text are the ids of its chunks in order.

1. Texts are cut into blocks of ``BLOCK_BYTES``; a block keeps its distinct chunks, dealt to
   buckets by hash, and for each place of its texts the number of the chunk there.
2. A bucket meets all blocks' lists and segments each distinct chunk once.
3. The ids come back to their block, are joined to the places and decoded.

A chunk that every text has is one entry a block, so frequent chunks make no large group, and the
buckets grow with the text. A block holds whole texts: memory is some ten bytes a text byte of
the larger of ``BLOCK_BYTES`` and the longest text.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.llm.tables import documents, slices

BLOCK_BYTES = 8 << 20
#: Text bytes of the whole table that one bucket of chunks stands for.
BUCKET_BYTES = 16 << 20
MARKER = "▁"
_models: dict[str, object] = {}


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the installed public tokenizer file of that name is."""
    import public_tokenizers
    return public_tokenizers.path(name)


def processor(path: str):
    """The library's encoder of a file, one in each Python worker."""
    if path not in _models:
        import sentencepiece
        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def check_model(path: str) -> None:
    """Raise ValueError where chunks could not be segmented apart."""
    from sentencepiece import sentencepiece_model_pb2 as messages
    model = messages.ModelProto()
    model.ParseFromString(processor(path).serialized_model_proto())
    rule = model.normalizer_spec
    if rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.add_dummy_prefix:
        raise ValueError("the model rewrites texts before it cuts them")
    if model.trainer_spec.model_type != messages.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
        raise ValueError("chunks are independent for byte-pair models with byte fallback only")
    for piece in model.pieces:
        if piece.type == messages.ModelProto.SentencePiece.USER_DEFINED or MARKER in piece.piece.lstrip(MARKER):
            raise ValueError(f"the piece {piece.piece!r} can cross a whitespace marker")


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes."""
    import zstandard
    planes = np.ascontiguousarray(values, np.uint32).view(np.uint8).reshape(-1, 4)
    used = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    return bytes([used]) + zstandard.ZstdCompressor(level=3).compress(planes[:, :used].T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    import zstandard
    used = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(used, -1)
    values = np.zeros((planes.shape[1], 4), np.uint8)
    values[:, :used] = planes.T
    return values.view(np.uint32).ravel()


def _buffers(strings: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets from 0 and the bytes of an array of large strings, a slice of one included."""
    if len(strings) == 0:
        return np.zeros(1, np.int64), memoryview(b"")
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset: strings.offset + len(strings) + 1]
    return offsets - offsets[0], memoryview(strings.buffers()[2] or b"")[offsets[0]: offsets[-1]]


def pack_strings(strings: pa.LargeStringArray) -> bytes:
    """The compressed lengths behind their size in four bytes, and the compressed bytes."""
    import zstandard
    offsets, data = _buffers(strings)
    lengths = pack(np.diff(offsets))
    return len(lengths).to_bytes(4, "little") + lengths + zstandard.ZstdCompressor(level=3).compress(data)


def unpack_strings(data: bytes) -> pa.LargeStringArray:
    import zstandard
    size = int.from_bytes(data[:4], "little")
    offsets = np.concatenate([[0], np.cumsum(unpack(data[4: 4 + size]), dtype=np.int64)])
    body = zstandard.ZstdDecompressor().decompress(data[4 + size:])
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(body))


def cut_chunks(texts: pa.Array) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The chunks of all texts, markers written as blanks, and the number of each text's chunks."""
    marked = pc.replace_substring(texts.cast(pa.large_string()), MARKER, " ")
    marked = pc.if_else(pc.equal(pc.binary_length(marked), 0), marked,
                        pc.binary_join_element_wise(pa.scalar("", pa.large_string()), marked,
                                                    pa.scalar(" ", pa.large_string())))
    if len(marked) == 0:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    if isinstance(marked, pa.ChunkedArray):
        marked = marked.combine_chunks()
    bounds, data = _buffers(marked)
    data = np.frombuffer(data, np.uint8)
    blank = data == 32
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    begins[bounds[:-1][np.diff(bounds) > 0]] = True
    starts = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(starts, bounds))
    ends = np.append(starts, len(data)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data)), counts


def string_hashes(strings: pa.LargeStringArray) -> np.ndarray:
    """64-bit keys of the strings' bytes; they only deal chunks to buckets."""
    import xxhash
    offsets, data = _buffers(strings)
    bounds = offsets.tolist()
    return np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(bounds, bounds[1:])), np.uint64, len(strings))


@dataclass
class _Blocks:
    """Cuts Arrow batches into blocks: their places, one row each, or their chunks, one row a bucket."""

    buckets: int
    block_bytes: int
    places: bool

    places_schema = "block long, bucket int, mark long, doc_ids array<long>, counts binary, payload binary"
    chunks_schema = "block long, bucket int, mark long, payload binary"

    def __call__(self, batches):
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, limit=self.block_bytes):
                part_size = int(pc.sum(pc.binary_length(part.column("text"))).as_py() or 0)
                if held and size + part_size > self.block_bytes:
                    yield self.block(number, held)
                    number, held, size = number + 1, [], 0
                held.append(part)
                size += part_size
        if held:
            yield self.block(number, held)

    def block(self, number: int, parts: list) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        texts = pa.chunked_array([c.cast(pa.large_string()) for c in table.column("text").chunks]).combine_chunks()
        chunks, counts = cut_chunks(texts)
        coded = chunks.dictionary_encode()
        found = coded.dictionary
        hashes = string_hashes(found)
        mark = _mark(hashes, counts)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.lexsort([pc.rank(found, tiebreaker="first").to_numpy() if len(found) else bucket, bucket])
        if self.places:
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            return pa.record_batch({
                "block": pa.array([number], pa.int64()), "bucket": pa.array([-1], pa.int32()),
                "mark": pa.array([mark], pa.int64()),
                "doc_ids": pa.array([table.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                "counts": pa.array([pack(counts)], pa.binary()),
                "payload": pa.array([pack(rank[coded.indices.to_numpy()])], pa.binary())})
        found = found.take(pa.array(order))
        used, firsts = np.unique(bucket[order], return_index=True)
        lists = [pack_strings(found.slice(a, b - a)) for a, b in zip(firsts, np.append(firsts, len(found))[1:])]
        return pa.record_batch({
            "block": pa.array([number] * len(lists), pa.int64()), "bucket": pa.array(used, pa.int32()),
            "mark": pa.array([mark] * len(lists), pa.int64()), "payload": pa.array(lists, pa.binary())})


def _mark(hashes: np.ndarray, counts: np.ndarray) -> int:
    """Tells whether a block holds the same chunks on another read."""
    import xxhash
    return xxhash.xxh3_64_intdigest(hashes.tobytes() + counts.tobytes()) >> 1


@dataclass
class _Segment:
    """Segments each distinct chunk of a bucket once; rows come sorted by bucket."""

    path: str

    schema = "block long, bucket int, mark long, payload binary, counts binary"

    def __call__(self, batches):
        current, rows = None, []
        for batch in batches:
            for block, bucket, mark, data in zip(*(column.to_pylist() for column in batch.columns)):
                if bucket != current and rows:
                    yield self.bucket(current, rows)
                    rows = []
                current = bucket
                rows.append((block, mark, data))
        if rows:
            yield self.bucket(current, rows)

    def bucket(self, bucket: int, rows: list) -> pa.RecordBatch:
        model = processor(self.path)
        lists = [unpack_strings(data) for _, _, data in rows]
        coded = pa.concat_arrays(lists).dictionary_encode()
        # The library puts the first marker there by itself.
        chunks = pc.utf8_slice_codeunits(coded.dictionary, 1)
        ids, lengths = [], np.zeros(len(chunks), np.int64)
        for first in range(0, len(chunks), 20_000):
            encoded = model.encode(chunks[first: first + 20_000].to_pylist(), num_threads=1)
            # A lone marker: the library puts none before an empty text.
            encoded = [e or [model.piece_to_id(MARKER)] for e in encoded]
            lengths[first: first + len(encoded)] = [len(e) for e in encoded]
            ids.append(np.fromiter(chain.from_iterable(encoded), np.uint32))
        ids = np.concatenate(ids)
        begins = np.cumsum(lengths) - lengths
        places = coded.indices.to_numpy()
        payloads, counts, first = [], [], 0
        for strings in lists:
            at = places[first: first + len(strings)]
            first += len(strings)
            counts.append(pack(lengths[at]))
            payloads.append(pack(ids[_spread(begins[at], lengths[at])]))
        return pa.record_batch({
            "block": pa.array([block for block, _, _ in rows], pa.int64()),
            "bucket": pa.array([bucket] * len(rows), pa.int32()),
            "mark": pa.array([mark for _, mark, _ in rows], pa.int64()),
            "payload": pa.array(payloads, pa.binary()), "counts": pa.array(counts, pa.binary())})


def _spread(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of runs given by where they begin and how long they are."""
    ends = np.cumsum(lengths)
    return np.repeat(begins - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def piece_texts(path: str) -> pa.LargeBinaryArray:
    """The bytes that each id stands for; none for ids that are no part of a text."""
    model = processor(path)
    texts = []
    for number in range(model.get_piece_size()):
        if model.is_control(number) or model.is_unknown(number):
            texts.append(b"")
        elif model.is_byte(number):
            texts.append(bytes([int(model.id_to_piece(number)[1:-1], 16)]))
        else:
            texts.append(model.id_to_piece(number).replace(MARKER, " ").encode())
    return pa.array(texts, pa.large_binary())


@dataclass
class _Join:
    """Joins ids back to the places of a block's texts, and decodes them."""

    path: str

    schema = "doc_id long, ids array<int>, decoded string"

    def __call__(self, group: pa.Table) -> pa.Table:
        group = group.sort_by("bucket")
        row = group.slice(0, 1).to_pylist()[0]
        if row["bucket"] != -1 or set(group.column("mark").to_pylist()) != {row["mark"]}:
            raise RuntimeError("the table gave other rows when it was read again; write it first")
        at, counts = unpack(row["payload"]), unpack(row["counts"]).astype(np.int64)
        found = group.slice(1)
        none = np.zeros(0, np.uint32)
        ids = np.concatenate([none, *map(unpack, found.column("payload").to_pylist())]).astype(np.int32)
        lengths = np.concatenate([none, *map(unpack, found.column("counts").to_pylist())]).astype(np.int64)
        if len(at) and int(at.max()) >= len(lengths):
            raise RuntimeError("ids of a block are missing")
        begins = np.cumsum(lengths) - lengths
        bounds = np.concatenate([[0], np.cumsum(counts)])
        texts, tables, first = piece_texts(self.path), [], 0
        while first < len(counts):
            # Documents of some two million chunks together, or one longer one.
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + 2_000_000, "right")) - 1)
            here = at[bounds[first]: bounds[last]]
            flat = ids[_spread(begins[here], lengths[here])]
            ends = np.concatenate([[0], np.cumsum(lengths[here])])[bounds[first: last + 1] - bounds[first]]
            tables.append(self.documents(row["doc_ids"][first: last], flat, ends, texts))
            first = last
        return pa.concat_tables(tables)

    def documents(self, doc_ids: list, flat: np.ndarray, ends: np.ndarray, texts: pa.LargeBinaryArray) -> pa.Table:
        offsets, data = _buffers(texts.take(pa.array(flat)))
        decoded = pa.LargeStringArray.from_buffers(len(doc_ids), pa.py_buffer(offsets[ends]), pa.py_buffer(data))
        flat = np.insert(flat, ends[1:], np.int32(processor(self.path).eos_id()))
        ends = (ends + np.arange(len(ends))).astype(np.int32)
        return pa.table({
            "doc_id": pa.array(doc_ids, pa.int64()),
            "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())),
            # The marker that the library puts before every text goes again.
            "decoded": pc.utf8_slice_codeunits(decoded, 1).cast(pa.string())})


def encode_pieces(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id",
                  block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``(doc_id, ids, decoded)``: each row's ids with the end id, and the text decoded from them.

    One row for each row of ``docs``, repeated and null ids included; a null text is empty and has
    the end id alone. Other columns are left out. Equals the library on whole texts.

    ``docs`` is read twice, for its chunks and for their places, which saves a copy of the places;
    files give the same rows in the same order each time. Blocks that differ raise an error, so
    stage the result of a shuffle first.
    """
    check_model(path)
    texts = documents(docs, doc_id, text)
    total = texts.agg(F.sum(F.octet_length("text")).alias("bytes")).first().bytes or 0
    cut = max(1, -(-total // bucket_bytes)), block_bytes
    places = texts.mapInArrow(_Blocks(*cut, places=True), _Blocks.places_schema)
    chunks = texts.mapInArrow(_Blocks(*cut, places=False), _Blocks.chunks_schema)
    found = (chunks.repartition("bucket").sortWithinPartitions("bucket", "block")
             .mapInArrow(_Segment(path), _Segment.schema))
    # A block's places and the ids of its buckets meet in one group, the places first.
    rows = places.unionByName(found, allowMissingColumns=True)
    join = _Join(path)
    return rows.groupBy("block").applyInArrow(lambda group: join(group), _Join.schema)
