"""Near-duplicate join on word shingles by rare-first prefix filtering.

The shingles of a text are put in one global order, rare ones first. Two sets of
Jaccard similarity t or more share a shingle in their first ``n - ceil(t n) + 1``
ones, so only those are joined. Length and positional filters act on the joined rows,
a suffix filter on the remaining pairs, and each pair that is left is verified once
on the whole sets.

Frequencies are counted over all rows into a table of fixed size (shingles are hashed
into it). Any fixed order gives exact results; the frequencies only make it selective.

Equal sets are one node from the start. Inside a shared prefix shingle no all-pairs list
is made at first: pivots are compared with the members outside their component, more pivots
each round, and a pivot that has met every member leaves. Members of several components
that are still left meet each other in a last round. Links inside one component are not looked
for: they can not change it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingloom.llm.bitmap import bit_of, bitmap_column, key_bitmap, may_contain
from ratingloom.llm.components import components
from ratingloom.llm.tables import documents, slices, trim
from ratingloom.llm.text_keys import mix, shingle_sets
from ratingloom.session import StagedTable, stage

#: Slots of the frequency table are 2**FREQUENCY_BITS; ranges of the suffix filter.
FREQUENCY_BITS = 18
SUFFIX_RANGES = 64
#: Orders from which pivots are taken: members of a group meet about so many of them at first.
PIVOT_ORDERS = 8
#: Pivots of a key in each round; in the round after these all members left are pivots.
PIVOTS = (1, 8, 128)


@dataclass(frozen=True)
class Jaccard:
    """Shingle length in words and the least similarity, as a whole percentage."""

    shingle: int = 5
    percent: int = 80

    def prefix(self, count: int) -> int:
        return count - (self.percent * count + 99) // 100 + 1

    def least_common(self, total: Column) -> Column:
        """Fewest common shingles that reach the threshold, given both set sizes added."""
        return F.ceil(total * F.lit(self.percent) / F.lit(100.0 + self.percent) - F.lit(1e-9))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def set_key(shingles: np.ndarray) -> int:
    """A 64-bit key of a set, the same for equal sets."""
    total = np.add.reduce(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)
    return int(mix(np.array([total + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def range_counts(shingles: np.ndarray) -> bytes:
    """How many shingles of a set lie in each of 64 equal ranges of the key."""
    return np.bincount((shingles >> np.uint64(58)).astype(np.int64), minlength=SUFFIX_RANGES).astype("<u4").tobytes()


def _sets(docs: DataFrame, rule: Jaccard) -> StagedTable:
    """One row a document ``(doc_id, n, node, ranges)``, and frequency rows ``(slot, seen)`` of each task."""
    def run(batches: Iterator[pa.RecordBatch]):
        seen = np.zeros(1 << FREQUENCY_BITS, np.int64)
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"), rule.shingle)
                if sets:
                    seen += np.bincount((np.concatenate(sets) >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64),
                                        minlength=len(seen))
                count = len(sets)
                yield pa.record_batch({
                    "doc_id": part.column("doc_id"), "n": pa.array([len(s) for s in sets], pa.int64()),
                    "node": pa.array([set_key(s) for s in sets], pa.int64()),
                    "ranges": pa.array([range_counts(s) for s in sets], pa.binary()),
                    "slot": pa.nulls(count, pa.int32()), "seen": pa.nulls(count, pa.int64())})
        slots = np.flatnonzero(seen)
        for k in range(0, len(slots), 1 << 15):
            some = slots[k: k + (1 << 15)]
            empty = pa.nulls(len(some), pa.int64())
            yield pa.record_batch({"doc_id": empty, "n": empty, "node": empty,
                                   "ranges": pa.nulls(len(some), pa.binary()),
                                   "slot": pa.array(some, pa.int32()), "seen": pa.array(seen[some])})
        trim()
    return stage(docs.mapInArrow(run, "doc_id long, n long, node long, ranges binary, slot int, seen long"), "sets")


def _frequencies(sets: DataFrame):
    """Broadcast counts by slot: at most 2**FREQUENCY_BITS rows, whatever the input."""
    counted = sets.where("slot is not null").groupBy("slot").agg(F.sum("seen").alias("seen")).toArrow()
    table = np.zeros(1 << FREQUENCY_BITS, np.int64)
    table[counted.column("slot").to_numpy()] = counted.column("seen").to_numpy()
    return sets.sparkSession.sparkContext.broadcast(table)


def _postings(docs: DataFrame, frequencies, chosen, rule: Jaccard, wanted=None) -> DataFrame:
    """``(key, node, place)`` of each prefix shingle; a set seen before in the task is left out.

    ``place`` packs the size of the set and the position in its prefix. ``chosen`` is a bitmap of the ids
    that stand for the sets, so most copies are not read; ``wanted`` is one of keys worth emitting.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        counts, stands, met = frequencies.value, chosen.value, set()
        filled = wanted.value if wanted is not None else None
        for batch in batches:
            for part in slices(batch.filter(pa.array(may_contain(stands, batch.column("id").to_numpy().view(np.uint64))))):
                keys, nodes, places = [], [], []
                for shingles in shingle_sets(part.column("text"), rule.shingle):
                    size = len(shingles)
                    node = set_key(shingles)
                    if size == 0 or node in met:
                        continue
                    if len(met) < 1 << 16:
                        met.add(node)
                    rare = counts[(shingles >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64)]
                    prefix = shingles[np.argsort(rare, kind="stable")[: rule.prefix(size)]]
                    place = np.arange(len(prefix), dtype=np.int64) + (size << 31)
                    if filled is not None:
                        keep = may_contain(filled, prefix)
                        prefix, place = prefix[keep], place[keep]
                    keys.append(prefix)
                    places.append(place)
                    nodes.append(np.full(len(prefix), node))
                if keys:
                    yield pa.record_batch({"key": _signed(np.concatenate(keys)),
                                           "node": pa.array(np.concatenate(nodes)),
                                           "place": pa.array(np.concatenate(places))})
        met.clear()
        trim()
    return docs.select("text", F.xxhash64("doc_id").alias("id")).mapInArrow(run, "key long, node long, place long")


def _shared_postings(docs: DataFrame, classes: DataFrame, frequencies, rule: Jaccard) -> StagedTable:
    """Postings ``(key, node, place)`` of the keys that several rows have in their prefixes."""
    chosen = key_bitmap(classes.select(F.xxhash64("least").alias("id")), "id")
    repeated = stage(_postings(docs, frequencies, chosen, rule).groupBy("key").agg(F.count("*").alias("n"))
                     .where("n > 1").select("key"), "keys")
    wanted = key_bitmap(repeated.df, "key")
    # Rows that lie by key after the join are not shuffled again to be grouped.
    rows = (_postings(docs, frequencies, chosen, rule, wanted).join(repeated.df, "key")
            .groupBy("key", "node").agg(F.min("place").alias("place")))
    shared = stage(rows, "postings")
    for bitmap in (wanted, chosen):
        bitmap.destroy()
    repeated.drop()
    return shared


def _size(place: Column) -> Column:
    return F.shiftright(place, 31)


def _position(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << 31) - 1))


def _passes(a: str, b: str, rule: Jaccard) -> Column:
    """Length filter and positional filter at a common key."""
    sizes = _size(F.col(a)), _size(F.col(b))
    tail = F.least(sizes[0] - _position(F.col(a)), sizes[1] - _position(F.col(b)))
    long_enough = 100 * F.least(*sizes) >= rule.percent * F.greatest(*sizes)
    return long_enough & (tail >= rule.least_common(sizes[0] + sizes[1]))


def _pivots(active: DataFrame, width: int) -> StagedTable:
    """Up to ``width`` members of each key, by one of a few pseudo-random orders.

    The order depends on the key, so the members of a group do not all meet one pivot. They
    are minima, so a frequent key is aggregated before the shuffle.
    """
    order = F.xxhash64("node", F.pmod("key", F.lit(PIVOT_ORDERS)))
    carried = [c for c in ("node", "place", "component") if c in active.columns]
    least = active.groupBy("key", F.pmod(order, F.lit(width)).alias("lane")).agg(
        F.min(F.struct(order.alias("order"), *carried)).alias("m"))
    return stage(_as_pivots(least.select("key", *(f"m.{c}" for c in carried))), "pivots")


def _as_pivots(members: DataFrame) -> DataFrame:
    return members.select("key", *(F.col(c).alias("pivot" if c == "node" else f"pivot_{c}")
                                   for c in ("node", "place", "component") if c in members.columns))


def _candidates(active: DataFrame, pivots: DataFrame | None, rule: Jaccard) -> StagedTable:
    """Distinct pairs of a pivot (None: every member is one) and the members of its key in other components.

    Before the first round no components are known. Both sides are plain tables, so Spark splits the rows
    of a frequent key.
    """
    known = "component" in active.columns
    apart = F.col("component") != F.col("pivot_component") if known else F.col("node") != F.col("pivot")
    if pivots is None:
        pivots = _as_pivots(active)
        apart &= F.col("node") < F.col("pivot")
    pairs = (active.join(pivots, "key")
             .where(apart & _passes("place", "pivot_place", rule))
             .select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct())
    return stage(pairs, "pairs")


def _likely(pairs: DataFrame, classes: DataFrame, rule: Jaccard) -> StagedTable:
    """Pairs that pass the suffix filter, with a document of each side: ``(a, b, a_doc, b_doc)``.

    Common shingles can not exceed the sum, over 64 ranges of the key, of the smaller count.
    """
    def bounded(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, SUFFIX_RANGES)
                           .astype(np.int64) for c in ("a_ranges", "b_ranges"))
            total = left.sum(1) + right.sum(1)
            keep = (100 + rule.percent) * np.minimum(left, right).sum(1) >= rule.percent * total
            yield batch.select(["a", "b", "a_doc", "b_doc"]).filter(pa.array(keep))
        trim()

    light = pairs
    for name in ("a", "b"):
        light = light.join(classes.select(F.col("node").alias(name), F.col("ranges").alias(f"{name}_ranges"),
                                          F.col("least").alias(f"{name}_doc")), name)
    return stage(light.mapInArrow(bounded, "a long, b long, a_doc long, b_doc long"), "likely")


def _whole_sets(docs: DataFrame, pairs: DataFrame, rule: Jaccard) -> StagedTable:
    """The whole sets ``(node, n, shingles)`` that pairs need, from documents that hold them; others may be among them.

    No text is shuffled: bitmaps of fixed size tell which documents may be wanted, and which of their sets.
    """
    ends = pairs.select(F.explode(F.array(*(F.struct(F.col(x).alias("node"), F.col(f"{x}_doc").alias("doc_id"))
                                            for x in ("a", "b")))).alias("end")).select("end.*")
    wanted = key_bitmap(ends, "node")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch):
                built = [(set_key(s), s) for s in shingle_sets(part.column("text"), rule.shingle) if len(s)]
                nodes = np.array([node for node, _ in built], np.int64)
                keep = np.flatnonzero(may_contain(wanted.value, nodes.view(np.uint64)))
                yield pa.record_batch({
                    "node": pa.array(nodes[keep]),
                    "n": pa.array([len(built[k][1]) for k in keep], pa.int64()),
                    "shingles": pa.array([built[k][1].astype("<u8").tobytes() for k in keep], pa.binary())})
        trim()

    bitmap = bitmap_column(ends.select(F.xxhash64("doc_id").alias("h")), "h")
    built = stage(docs.where(bit_of(bitmap, F.xxhash64("doc_id"))).mapInArrow(run, "node long, n long, shingles binary"), "whole")
    wanted.destroy()
    return built


def _common(a: bytes, b: bytes) -> int:
    return len(np.intersect1d(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8"), assume_unique=True))


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, rule: Jaccard) -> StagedTable:
    """Pairs whose whole sets are similar enough: ``(a, b, common, total)``."""
    def exact(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            common = np.array([_common(x.as_buffer(), y.as_buffer()) for x, y in
                               zip(batch.column("a_shingles"), batch.column("b_shingles"))], np.int64)
            total = batch.column("a_n").to_numpy() + batch.column("b_n").to_numpy() - common
            keep = pa.array(100 * common >= rule.percent * total)
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "common": pa.array(common),
                                   "total": pa.array(total)}).filter(keep)
        trim()

    left = _likely(pairs, classes, rule)
    sets = _whole_sets(docs, left.df, rule)
    whole = left.df.select("a", "b")
    for name in ("a", "b"):
        whole = whole.join(sets.df.select(F.col("node").alias(name), F.col("n").alias(f"{name}_n"),
                                          F.col("shingles").alias(f"{name}_shingles")), name)
    links = stage(whole.mapInArrow(exact, "a long, b long, common long, total long"), "links")
    left.drop()
    sets.drop()
    return links


def _open(postings: DataFrame, labels: DataFrame | None) -> StagedTable:
    """Postings of the keys whose members lie in more than one component, with the component."""
    if labels is None:
        placed = postings.withColumn("component", F.col("node"))
    else:
        placed = (postings.drop("component").join(labels, "node", "left")
                  .withColumn("component", F.coalesce("component", "node")))
    placed = stage(placed, "placed")
    spread = (placed.df.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
              .where("low < high").select("key"))
    rows = stage(placed.df.join(spread, "key"), "open")
    placed.drop()
    return rows


def similar_sets(docs: DataFrame, rule: Jaccard) -> tuple[StagedTable, StagedTable, StagedTable]:
    """``(doc_id, n, node)`` of every row, ``(node, least)`` of the sets, ``(node, component)`` of linked sets."""
    sets = _sets(docs, rule)
    classes = stage(sets.df.where("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.first("ranges", True).alias("ranges")), "nodes")
    frequencies = _frequencies(sets.df)
    # Ranges and counts of tasks are read no more: they should not lie on disk all the while.
    rows = stage(sets.df.where("slot is null").select("doc_id", "n", "node"), "rows")
    sets.drop()
    active = _shared_postings(docs, classes.df, frequencies, rule)
    frequencies.destroy()
    labels: StagedTable | None = None
    for width in (*PIVOTS, None):
        pivots = width and _pivots(active.df, width)
        pairs = _candidates(active.df, pivots and pivots.df, rule)
        found = _verified(docs, pairs.df, classes.df, rule)
        pairs.drop()
        if found.df.limit(1).count():
            known = labels
            links = found.df.select("a", "b")
            labels = components(links if known is None else links.unionByName(
                known.df.select(F.col("node").alias("a"), F.col("component").alias("b"))))
            if known:
                known.drop()
        found.drop()
        if pivots is None:
            break
        met = active.df.join(pivots.df.withColumnRenamed("pivot", "node").select("key", "node"),
                             ["key", "node"], "left_anti")
        following = _open(met, labels and labels.df)
        pivots.drop()
        active.drop()
        active = following
        if not active.df.limit(1).count():
            break
    active.drop()
    return rows, classes, labels or stage(docs.sparkSession.createDataFrame([], "node long, component long"), "components")


def near_duplicates(docs: DataFrame, rule: Jaccard = Jaccard(), doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``.

    Texts link when their sets of word shingles (A-Z folded) have at least the given
    similarity; ``component_id`` is the smallest id reached by links. A null or wordless
    text has no shingles, links with nothing and is its own component; a text of fewer
    words than a shingle is one shingle. Repeated rows appear as often as they come; rows
    that share an id each follow their own text. A row with a null id belongs to the component
    of the rows with equal sets and an id; without such a row it links with nothing and its
    component is null. An empty table gives an empty table. Other columns of ``docs`` are not looked at.
    """
    rows = documents(docs, doc_id, text)
    own, classes, labels = similar_sets(rows, rule)
    placed = stage(classes.df.select("node", "least").join(labels.df, "node", "left")
                   .withColumn("component", F.coalesce("component", "node")), "classes")
    least = stage(placed.df.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    named = stage(placed.df.join(least.df, "component").select("node", "component_id"), "named")
    for table in (classes, labels, placed, least):
        table.drop()
    return own.df.join(named.df, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
