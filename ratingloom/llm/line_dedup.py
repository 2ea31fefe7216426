"""Line deduplication over overlapping windows of three lines.

A line ends at a line break or after a word that ends a sentence (``.``, ``!``, ``?``);
lines are compared by their words, so that blanks and the wrapping of a paragraph do not
matter. Every three consecutive lines of a document are hashed. A window that occurs again,
in the same or another document, is removed wherever it occurs later: the lines that removed
windows cover are cut, overlapping windows being merged.

With ``LineRule.span`` long lines are cut further, into pieces, at places that depend on the
words within ``span`` of them alone, so that a passage is found inside lines that differ
around it. Runs of three or more pieces and ten or more words are windows, too; a window of
three whole lines still is one, whatever its length.

Windows and lines travel packed: a task sorts what it found by the top bits of the key and sends a
row of binaries a bucket. Of equal windows a task sends the least only, the others being known to go.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.llm.bitmap import FILTER_BITS, may_contain
from ratingloom.llm.tables import slices, text_column, trim
from ratingloom.llm.text_keys import BLANKS, mix, utf8, windows, words
from ratingloom.session import stage

_BLANK = np.zeros(256, dtype=bool)
_BLANK[list(BLANKS)] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?"]] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)
_UNSTEP = np.uint64(pow(int(_STEP), -1, 1 << 64))

#: Windows travel packed, many to a row, by the top bits of their keys; a task handles a bucket at a time.
BUCKET_BITS = 12
#: Keys, and entries of 32 bytes, that a task gathers before it packs them.
HELD_KEYS = 1 << 20
HELD_ENTRIES = 1 << 18


@dataclass(frozen=True)
class LineRule:
    """Lines in a window, and the words that a window needs to count (0: all count; short ones repeat by chance, too)."""

    lines: int = 3
    words: int = 10
    #: Longest piece of a line in words; 0 leaves lines whole.
    span: int = 0
    #: Words of a window that begins, ends or is cut inside a line.
    piece_words: int = 10


#: Every window counts, however short, and long lines are cut: the rule of the query and of the pipeline.
#: Any run of 6 * span - 1 = 47 words or more holds a window, wherever it stands.
WHOLE = LineRule(words=0, span=8)


@dataclass
class Lines:
    """Lines of several texts: keys, byte starts, word counts, and each text's first line (one more).

    With a span these are pieces of lines; ``whole`` tells which begin a line, ``sums`` are running
    sums of the words' keys by which any run of pieces has a key.
    """

    keys: np.ndarray
    starts: np.ndarray
    words: np.ndarray
    firsts: np.ndarray
    whole: np.ndarray | None = None
    sums: np.ndarray | None = None
    inverse: np.ndarray | None = None


def _pieces(keys: np.ndarray, new: np.ndarray, span: int) -> np.ndarray:
    """Which words begin a piece: those after the least word, the last of equals, of any ``span`` words of a line."""
    rank = (keys >> np.uint64(32)).astype(np.uint32)
    line = np.cumsum(new, dtype=np.int32)
    count = len(keys)
    reach = np.ones(count, np.uint8)
    after, before = np.ones(count, bool), np.ones(count, bool)
    for k in range(1, min(span, count)):
        same = line[k:] == line[:-k]
        less = rank[:-k] < rank[k:]
        after[:-k] &= same & less
        after[count - k:] = False
        before[k:] &= same & ~less
        before[:k] = False
        reach += after
        reach += before
    begins = new.copy()
    begins[1:] |= (reach >= span)[:-1]
    return begins


def lines_of(texts: pa.Array, span: int = 0) -> Lines:
    """Find the lines of whole texts; ``starts`` count from the first byte of the first text."""
    data, offsets = utf8(texts)
    found = words(texts, lower=False)
    count = len(found.keys)
    if count == 0:
        none = np.zeros(0, np.int64)
        return Lines(found.keys, none, none, np.zeros(len(offsets), np.int64))
    breaks = np.cumsum(data == 10, dtype=np.int64)
    last = np.flatnonzero(~_BLANK[data] & np.append(_BLANK[data[1:]], True))
    # The last byte of a word stands before a blank; at the end of a text no blank need follow.
    ends = np.union1d(last, offsets[1:][np.diff(offsets) > 0] - 1)
    ends = ends[~_BLANK[data[ends]]]
    new = np.ones(count, dtype=bool)
    new[1:] = _STOP[data[ends[:-1]]] | (breaks[found.starts[1:]] > breaks[found.starts[:-1]])
    new[found.firsts[:-1][found.counts > 0]] = True
    pieces = _pieces(found.keys, new, span) if span else new
    begins = np.flatnonzero(pieces)
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(count, _STEP)]))
    inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(count, _UNSTEP)]))
    values = found.keys * powers[:count]
    keys = np.add.reduceat(values, begins) * inverse[begins]
    lines = Lines(keys, found.starts[begins], np.diff(np.append(begins, count)),
                  np.searchsorted(begins, found.firsts))
    if span:
        lines.whole = new[begins]
        lines.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])[np.append(begins, count)]
        lines.inverse = inverse[begins]
    return lines


def _line_windows(lines: Lines, rule: LineRule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the windows that count, the text of each, and ``first line << 32 | end`` inside that text."""
    none = np.zeros(0, np.int64)
    if len(lines.keys) == 0:
        return lines.keys, none, none
    words_before = np.concatenate([[0], np.cumsum(lines.words)])
    # Whole lines: the places of their first pieces.
    begins = np.arange(len(lines.keys)) if lines.whole is None else np.flatnonzero(lines.whole)
    edges = np.append(begins, len(lines.keys))
    whole_keys = lines.keys
    if lines.whole is not None:
        whole_keys = (lines.sums[edges[1:]] - lines.sums[begins]) * lines.inverse[begins]
    keys = windows(whole_keys, rule.lines)
    low, high = begins[: len(keys)], edges[rule.lines: rule.lines + len(keys)]
    keep = words_before[high] - words_before[low] >= rule.words
    keys, low, high = keys[keep], low[keep], high[keep]
    if lines.whole is not None:
        first = np.arange(len(lines.keys))
        end = np.searchsorted(words_before, words_before[:-1] + rule.piece_words, side="left")
        end = np.maximum(end, first + rule.lines)
        first, end = first[end <= len(lines.keys)], end[end <= len(lines.keys)]
        # Runs without a cut inside a line are windows of whole lines already.
        inner = np.concatenate([[0], np.cumsum(~lines.whole), [0]])
        inner[-1] = inner[-2]
        cut = inner[end + 1] > inner[first]
        first, end = first[cut], end[cut]
        runs = mix((lines.sums[end] - lines.sums[first]) * lines.inverse[first])
        keys, low, high = np.concatenate([keys, runs]), np.concatenate([low, first]), np.concatenate([high, end])
    text = np.searchsorted(lines.firsts, low, side="right") - 1
    keep = high <= lines.firsts[text + 1]
    keys, low, high, text = keys[keep], low[keep], high[keep], text[keep]
    return keys, text, (low - lines.firsts[text]) << 32 | (high - lines.firsts[text])


def _bucket(keys: np.ndarray) -> np.ndarray:
    """The top bits of unsigned keys: windows, or rows, of one bucket meet in one place."""
    return (keys >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def _packs(bucket: np.ndarray, **columns: np.ndarray) -> dict[str, pa.Array]:
    """One row a bucket with its values of each column in a binary; ``bucket`` ascends."""
    firsts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(firsts[1:], len(bucket))
    packed = {"bucket": pa.array(bucket[firsts], pa.int32())}
    for name, values in columns.items():
        offsets = np.append(firsts, ends[-1:]) * values.dtype.itemsize
        packed[name] = pa.Array.from_buffers(pa.binary(), len(firsts), [
            None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])
    return packed


def _by_bucket(packs: DataFrame) -> DataFrame:
    return packs.repartition("bucket").sortWithinPartitions("bucket")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each bucket, one bucket after the other, from sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        buckets = batch.column("bucket").to_numpy()
        edges = np.append(np.flatnonzero(np.diff(buckets)) + 1, len(buckets))
        first = 0
        for end in edges:
            if held and held[0].column("bucket")[0].as_py() != buckets[first]:
                yield held[0].column("bucket")[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(first, end - first))
            first = end
    if held:
        yield held[0].column("bucket")[0].as_py(), pa.Table.from_batches(held)


def _unpacked(table: pa.Table, name: str, kind=np.int64) -> np.ndarray:
    """The values of a packed column, in the order of the rows."""
    return np.frombuffer(b"".join(x.as_buffer() for x in table.column(name) if x.is_valid), kind)


def _repeated_bitmap(texts: DataFrame, rule: LineRule):
    """Broadcast bitmap of the windows that occur more than once; see ``bitmap.may_contain``."""
    def twice(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.sort(np.concatenate(held))
        # Two of equal keys tell that they are repeated.
        keep = np.ones(len(keys), bool)
        keep[2:] = keys[2:] != keys[:-2]
        return pa.record_batch(_packs(_bucket(keys[keep]), keys=keys[keep]))

    def run(batches: Iterator[pa.RecordBatch]):
        held, count = [], 0
        for batch in batches:
            for part in slices(batch):
                held.append(_line_windows(lines_of(part.column("text"), rule.span), rule)[0])
                count += len(held[-1])
                if count >= HELD_KEYS:
                    yield twice(held)
                    held, count = [], 0
        if count:
            yield twice(held)
        trim()

    bits = FILTER_BITS - BUCKET_BITS

    def fill(batches: Iterator[pa.RecordBatch]):
        for bucket, table in _grouped(batches):
            keys = np.sort(_unpacked(table, "keys", np.uint64))
            slots = (keys[1:][keys[1:] == keys[:-1]] >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            marks = np.zeros(1 << bits, np.uint8)
            marks[slots & ((1 << bits) - 1)] = 1
            yield pa.record_batch({"bucket": pa.array([bucket], pa.int32()),
                                   "bits": pa.array([np.packbits(marks, bitorder="little").tobytes()])})
        trim()

    packs = texts.mapInArrow(run, "bucket int, keys binary")
    found = _by_bucket(packs).mapInArrow(fill, "bucket int, bits binary").toArrow()
    filled = np.zeros((1 << BUCKET_BITS, 1 << (bits - 6)), "<i8")
    for bucket, words_ in zip(found.column("bucket").to_pylist(), found.column("bits")):
        filled[bucket] = np.frombuffer(words_.as_buffer(), "<i8")
    return texts.sparkSession.sparkContext.broadcast(filled.reshape(-1))


def _starts(lines: Lines, offsets: np.ndarray) -> pa.Array:
    """Byte starts of each text's lines as steps from line to line, 255 a byte as long as a step goes on."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(lines.firsts))
    steps = np.diff(lines.starts, prepend=0)
    begins = lines.firsts[:-1][np.diff(lines.firsts) > 0]
    steps[begins] = lines.starts[begins] - offsets[text[begins]]
    ends = np.cumsum(steps // 255 + 1)
    data = np.full(ends[-1] if len(ends) else 0, 255, np.uint8)
    data[ends - 1] = steps % 255
    firsts = np.concatenate([[0], ends])[lines.firsts].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(firsts), pa.py_buffer(data)])


_ENTRY = ("keys", "docs", "rows", "lines")
_KNOWN = np.int64((1 << 63) - 1)


def _later(keys: np.ndarray, docs: np.ndarray, rows: np.ndarray, lines: np.ndarray):
    """Entries sorted by window, document, row and line, and which are first, or later than the first, of a window."""
    # A line is negative if the id of its document is null; such documents come first.
    order = np.lexsort((lines & _KNOWN, rows, docs, lines >= 0, keys))
    keys, docs, rows, lines = keys[order], docs[order], rows[order], lines[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)[np.cumsum(first) - 1]
    same = (docs == docs[at]) & (rows == rows[at]) & (lines == lines[at])
    return (keys, docs, rows, lines), first, ~same


def _row_packs(rows: np.ndarray, lines: np.ndarray) -> pa.RecordBatch:
    """Lines that go, ``first << 32 | end``, in the buckets of their rows, which follow those of the windows."""
    bucket = _bucket(rows.view(np.uint64))
    order = np.argsort(bucket, kind="stable")
    packs = _packs(bucket[order] + (1 << BUCKET_BITS), rows=rows[order], lines=(lines & _KNOWN)[order])
    empty = pa.nulls(len(packs["bucket"]), pa.binary())
    return pa.record_batch({"bucket": packs["bucket"], "keys": empty, "docs": empty, "rows": packs["rows"],
                            "lines": packs["lines"], "starts": empty})


_PACKED = "bucket int, keys binary, docs binary, rows binary, lines binary, starts binary"


def _entries(rows: DataFrame, rule: LineRule, wanted) -> DataFrame:
    """Packed windows of a task, the least of equal ones, by window; by row the lines of others, and where lines start."""
    def flushed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        entries, first, later = _later(*(np.concatenate(column) for column in zip(*held)))
        packs = _packs(_bucket(entries[0][first].view(np.uint64)), **{n: c[first] for n, c in zip(_ENTRY, entries)})
        yield pa.record_batch({**packs, "starts": pa.nulls(len(packs["bucket"]), pa.binary())})
        if later.any():
            yield _row_packs(entries[2][later], entries[3][later])

    def run(batches: Iterator[pa.RecordBatch]):
        held, count = [], 0
        for batch in batches:
            for part in slices(batch):
                found = lines_of(part.column("text"), rule.span)
                row = part.column("row").to_numpy()
                starts = _starts(found, utf8(part.column("text"))[1])
                empty = pa.nulls(len(row), pa.binary())
                yield pa.record_batch({
                    "bucket": pa.array(_bucket(row.view(np.uint64)) + (1 << BUCKET_BITS)), "keys": empty, "docs": empty,
                    "rows": pa.array(row).view(pa.binary(8)).cast(pa.binary()), "lines": empty, "starts": starts})
                keys, text, line = _line_windows(found, rule)
                keep = may_contain(wanted.value, keys)
                text, line = text[keep], line[keep]
                ids = part.column("doc_id")
                null = ids.is_null().to_numpy(zero_copy_only=False)[text]
                held.append((keys[keep].view(np.int64), ids.fill_null(0).to_numpy()[text], row[text],
                             np.where(null, line | ~_KNOWN, line)))
                count += len(line)
                if count >= HELD_ENTRIES:
                    yield from flushed(held)
                    held, count = [], 0
        if count:
            yield from flushed(held)
        trim()

    return rows.mapInArrow(run, _PACKED)


def _lines_that_go(entries: DataFrame) -> DataFrame:
    """Entries that are not the first of their window, by row; what is by row already passes through."""
    def run(batches: Iterator[pa.RecordBatch]):
        held, count = [], 0
        for bucket, table in _grouped(batches):
            if bucket >= 1 << BUCKET_BITS:
                yield from table.to_batches()
                continue
            (_, _, rows, lines), _, later = _later(*(_unpacked(table, name) for name in _ENTRY))
            held.append((rows[later], lines[later]))
            count += len(held[-1][0])
            if count >= HELD_ENTRIES:
                yield _row_packs(*(np.concatenate(column) for column in zip(*held)))
                held, count = [], 0
        if count:
            yield _row_packs(*(np.concatenate(column) for column in zip(*held)))
        trim()

    return _by_bucket(entries).mapInArrow(run, _PACKED)


def _covered(packs: DataFrame) -> DataFrame:
    """``(row, starts, lines)`` of every document: where its lines start, and those that go, merged, 16 bytes a run."""
    def run(batches: Iterator[pa.RecordBatch]):
        for _, table in _grouped(batches):
            listed = table.filter(pa.compute.is_valid(table.column("starts")))
            known, at = np.unique(_unpacked(listed, "rows"), return_index=True)
            marks = table.filter(pa.compute.is_null(table.column("starts")))
            rows, lines = _unpacked(marks, "rows"), _unpacked(marks, "lines")
            order = np.lexsort((lines, rows))
            rows, low, high = rows[order], lines[order] >> 32, lines[order] & 0xFFFFFFFF
            # Runs of one row overlap in one stretch of numbers; rows lie apart.
            place = np.searchsorted(known, rows)
            room = int(high.max(initial=0)) + 1
            reach = np.maximum.accumulate(place * room + high)
            new = np.ones(len(rows), bool)
            new[1:] = place[1:] * room + low[1:] > reach[:-1]
            new[1:] |= rows[1:] != rows[:-1]
            begins = np.flatnonzero(new)
            ends = np.append(begins[1:], len(rows))[: len(begins)]
            runs = np.stack([low[begins], (reach[ends - 1] - place[begins] * room)], axis=1)
            offsets = (np.searchsorted(place[begins], np.arange(len(known) + 1)) * 16).astype(np.int32)
            yield pa.record_batch({
                "row": pa.array(known), "starts": listed.column("starts").take(pa.array(at)).combine_chunks(),
                "lines": pa.Array.from_buffers(pa.binary(), len(known), [
                    None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(runs, np.int64))])})
        trim()

    return _by_bucket(packs).mapInArrow(run, "row long, starts binary, lines binary")


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all binaries and the offset of each (one more)."""
    if len(values) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset: values.offset + len(values) + 1].astype(np.int64)
    data = values.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def _cut(texts: pa.Array, starts: pa.Array, runs: pa.Array) -> pa.StructArray:
    """Texts without the runs of lines that go, and their lines in all and removed."""
    if starts.null_count:
        raise ValueError("a text has no known lines: the table changed between two reads")
    data, offsets = utf8(texts)
    steps, edges = _bytes(starts)
    ends = steps < 255
    before = np.concatenate([[0], np.cumsum(ends)])
    firsts = before[edges]
    count = int(before[-1])
    sums = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    begins = sums[1:][ends] - sums[edges][text] + offsets[text]
    places, marks = _bytes(runs)
    pairs = places.view(np.int64).reshape(-1, 2) + np.repeat(firsts[:-1], np.diff(marks) // 16)[:, None]
    change = np.zeros(count + 1, np.int64)
    np.add.at(change, pairs[:, 0], 1)
    np.add.at(change, pairs[:, 1], -1)
    gone = np.cumsum(change)[:count] > 0
    # A line reaches to the next one of its text, the last one to the end of the text.
    stops = np.append(begins[1:], 0)[:count]
    last = firsts[1:][np.diff(firsts) > 0] - 1
    stops[last] = offsets[text[last] + 1]
    kill = np.zeros(len(data) + 1, np.int8)
    kill[begins[gone]] += 1
    kill[stops[gone]] -= 1
    kept = np.cumsum(kill[:-1], dtype=np.int8) == 0
    bounds = np.concatenate([[0], np.cumsum(kept)])[offsets].astype(np.int32)
    return pa.StructArray.from_arrays([
        pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(bounds), pa.py_buffer(data[kept])]),
        pa.array(np.diff(firsts), pa.int64()),
        pa.array(np.diff(np.concatenate([[0], np.cumsum(gone)])[firsts]), pa.int64())], ["text", "n_lines", "n_removed"])


def dedup_lines(docs: DataFrame, rule: LineRule = LineRule(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of ``docs`` with ``text`` cut, and ``n_lines``, ``n_removed_lines`` (replacing columns so named).

    The first occurrence of a window, by id, text and line, stays; windows of fewer words than
    ``rule.words`` do not count. Rows with the same id and text are one document and are cut
    alike. Null ids come before others. A text that loses nothing is returned byte for byte, a
    null text as null; texts with fewer lines than a window lose nothing, texts of any length
    are read whole. With ``rule.span`` the counts are of pieces of lines. An empty table gives an empty table.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed_lines")]
    key = F.xxhash64(F.col(f"`{doc_id}`").cast("long"), text_column(text))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_column(text).alias("text"), key.alias("row"))
    wanted = _repeated_bitmap(rows.select("text"), rule)
    covered = stage(_covered(_lines_that_go(_entries(rows, rule, wanted))), "covered")
    wanted.destroy()
    covered_lines = covered.df.select(F.col("row").alias("__line_row"), F.col("starts").alias("__starts"),
                                      F.col("lines").alias("__lines"))

    @F.arrow_udf("struct<text string, n_lines long, n_removed long>")
    def cut(texts: pa.Array, starts: pa.Array, lines: pa.Array) -> pa.Array:
        batch = pa.record_batch({"text": texts, "starts": starts, "lines": lines})
        done = [_cut(*part.columns) for part in slices(batch)]
        trim()
        return pa.concat_arrays(done) if done else pa.array([], pa.struct(
            [("text", pa.string()), ("n_lines", pa.int64()), ("n_removed", pa.int64())]))

    # The same plan at every size: both sides grow with the documents.
    joined = docs.select(*[F.col(f"`{c}`") for c in names], key.alias("__line_key")).join(
        covered_lines.hint("merge"), F.col("__line_key") == F.col("__line_row"), "left")
    done = joined.withColumn("__cut", cut(text_column(text), F.col("__starts"), F.col("__lines")))
    return done.select(
        *[F.when(F.col(f"`{text}`").isNotNull(), F.col("__cut.text")).alias(text) if c == text else F.col(f"`{c}`")
          for c in names],
        F.col("__cut.n_lines").alias("n_lines"), F.col("__cut.n_removed").alias("n_removed_lines"))
