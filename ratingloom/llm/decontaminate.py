"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive words: some positions are hashed, others ignored, so
that a text still meets a benchmark item where words were replaced. The hashes of all masks at
all positions of the items are joined with those of the documents. A hit fixes how document
and item lie over each other; there the words are compared one by one and the overlap that
tolerates replaced words is measured.

The benchmark is the smaller table and is taken in blocks of bounded size, each broadcast;
documents are read once a block, whole, and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.llm.tables import documents, slices, text_column
from ratingloom.llm.text_keys import mix, words

#: Words of benchmark items in a block: its hashes and words take some 100 bytes each.
BLOCK_WORDS = 100_000
#: Slots of the table that most hashes of documents fail, 2**PREFILTER_BITS bytes.
PREFILTER_BITS = 20

# The masks; 1 is hashed, 0 ignored.
MASKS = ("1111011", "1101111", "11101011", "110110011", "101111001", "1100110101")


@dataclass(frozen=True)
class OverlapRule:
    """What counts as contamination: words equal in place, and their share of the overlap.

    Items of fewer words than ``min_equal`` can not be told from chance and are never reported.
    """

    min_equal: int = 10
    min_share: float = 0.7
    masks: tuple[str, ...] = MASKS


def seed_hashes(keys: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the unmasked words at each position where the mask fits."""
    count = len(keys) - len(mask) + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(count, len(mask) << 20 | int(mask, 2), np.uint64)
    for place, used in enumerate(mask):
        if used == "1":
            total = total * np.uint64(0x9FB21C651E98DF25) + keys[place: place + count]
    return mix(total)


class SeedIndex:
    """Seeds of a block of items: sorted hashes with item and position, and a table of their slots."""

    def __init__(self, items: list[tuple[list[int], str]], rule: OverlapRule):
        self.ids = [sorted(ids) for ids, _ in items]
        found = words(pa.array([text for _, text in items], pa.string()))
        self.words = [found.keys[a:b] for a, b in zip(found.firsts[:-1], found.firsts[1:])]
        hashes, owners, places = [], [], []
        for item, keys in enumerate(self.words):
            if len(keys) < rule.min_equal:
                continue
            for mask in rule.masks:
                some, first = np.unique(seed_hashes(keys, mask), return_index=True)
                hashes.append(some)
                owners.append(np.full(len(some), item))
                places.append(first)
        self.hashes, self.owners, self.places = (
            np.concatenate(x) if x else np.zeros(0, k) for x, k in
            ((hashes, np.uint64), (owners, np.int64), (places, np.int64)))
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.owners, self.places = self.hashes[order], self.owners[order], self.places[order]
        self.slots = np.zeros(1 << PREFILTER_BITS, dtype=bool)
        self.slots[self.hashes >> np.uint64(64 - PREFILTER_BITS)] = True

    def hits(self, keys: np.ndarray, masks: tuple[str, ...]) -> np.ndarray:
        """Distinct ``(item, shift)`` of all hits; ``shift`` is position in the text minus in the item."""
        pairs = []
        for mask in masks:
            hashed = seed_hashes(keys, mask)
            at = np.flatnonzero(self.slots[hashed >> np.uint64(64 - PREFILTER_BITS)])
            low = np.searchsorted(self.hashes, hashed[at], side="left")
            high = np.searchsorted(self.hashes, hashed[at], side="right")
            many = high - low
            entry = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
            pairs.append(np.column_stack([self.owners[entry], np.repeat(at, many) - self.places[entry]]))
        return np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)


def best_overlap(equal: np.ndarray, min_share: float) -> tuple[int, int]:
    """First and last (end exclusive) place of the stretch with the most equal words whose share is ``min_share``."""
    # A stretch has the share if and only if these weights sum to 0 or more; whole numbers, so nothing is rounded.
    share = Fraction(min_share).limit_denominator(1_000_000)
    gain, loss = share.denominator - share.numerator, -share.numerator
    totals = np.concatenate([[0], np.cumsum(np.where(equal, gain, loss), dtype=np.int64)])
    same = np.concatenate([[0], np.cumsum(equal, dtype=np.int64)])
    # The longest stretch to an end has the most equal words of it: from the first place whose total is not above the end's.
    lows = np.minimum.accumulate(totals)
    first = np.searchsorted(-lows, -totals, side="left")
    high = int(np.argmax(same - same[first]))
    low = int(first[high])
    # Unequal words at the edges add nothing.
    inside = np.flatnonzero(equal[low:high])
    return (low + int(inside[0]), low + int(inside[-1]) + 1) if len(inside) else (0, 0)


def overlaps(keys: np.ndarray, firsts: np.ndarray, index: SeedIndex, rule: OverlapRule) -> list[tuple]:
    """``(text, item, first word in text, first word in item, length, equal)``: the best of each text and item."""
    best: dict[tuple[int, int], tuple] = {}
    for item, shift in index.hits(keys, rule.masks).tolist():
        wanted = index.words[item]
        # A hit may straddle two texts: every text that the item's range touches is compared by itself.
        text = int(np.searchsorted(firsts, max(shift, 0), side="right")) - 1
        while text < len(firsts) - 1 and firsts[text] < shift + len(wanted):
            low, high = max(shift, int(firsts[text])), min(shift + len(wanted), int(firsts[text + 1]))
            if high - low >= rule.min_equal:
                equal = keys[low:high] == wanted[low - shift: high - shift]
                a, b = best_overlap(equal, rule.min_share)
                same = int(equal[a:b].sum())
                if same >= rule.min_equal:
                    row = (text, item, low + a - int(firsts[text]), low + a - shift, b - a, same)
                    if (text, item) not in best or best[text, item][5] < same:
                        best[text, item] = row
            text += 1
    return list(best.values())


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[list[int], str]]]:
    """The items in blocks of about ``block_words`` words, equal texts once with all their ids."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_column().alias("text"))
    size = items.agg(F.sum(F.size(F.split("text", r"[ \t-\r]+")))).first()[0] or 0
    count = max(1, -(-int(size) // block_words))
    numbered = items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(count)))
    for block in range(count):
        rows = numbered.where(F.col("block") == block).groupBy("text").agg(
            F.sort_array(F.collect_set("item_id")).alias("ids")).collect()
        if rows:
            yield [(list(row.ids), row.text) for row in sorted(rows, key=lambda r: (r.ids, r.text))]


def contaminated(docs: DataFrame, benchmark: DataFrame, rule: OverlapRule = OverlapRule(), doc_id: str = "doc_id",
                 text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Overlaps of documents with benchmark items: one row a document and item.

    ``(doc_id, item_id, doc_word, item_word, n_words, n_equal)``: the overlap begins at those
    words (from 0), is ``n_words`` long and has ``n_equal`` equal ones. A-Z are folded. Documents
    without an overlap have no row; null and empty texts and items overlap with nothing; repeated
    rows are reported as often as they come; items with equal texts are all reported, items with
    a null id are not. An empty table on either side gives an empty table.
    """
    rows = documents(docs, doc_id, text)
    spark = docs.sparkSession
    schema = "doc_id long, item_ids array<long>, doc_word long, item_word long, n_words long, n_equal long"
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = ("doc_id", "item_ids", "doc_word", "item_word", "n_words", "n_equal")

    def scan(index):
        def run(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                for part in slices(batch):
                    text_words = words(part.column("text"))
                    found = overlaps(text_words.keys, text_words.firsts, index.value, rule)
                    if not found:
                        continue
                    at, item, *rest = zip(*found)
                    ids = part.column("doc_id").take(pa.array(at, pa.int64()))
                    columns = (ids, [index.value.ids[i] for i in item], *rest)
                    yield pa.record_batch({n: c if isinstance(c, pa.Array) else pa.array(c, k)
                                           for n, c, k in zip(names, columns, kinds)})
        return run

    result = spark.createDataFrame([], schema)
    for items in _blocks(benchmark, block_words):
        index = spark.sparkContext.broadcast(SeedIndex(items, rule))
        result = result.unionByName(rows.mapInArrow(scan(index), schema))
    return result.select("doc_id", F.explode("item_ids").alias("item_id"), *names[2:])
