"""Scores and gradients with the factor rows of one side at hand and those of the other side read through.

Joins move a factor row for every rating, and a grid one for every cell that touches it: tables many times as large as
the factors. Here the ratings meet the factor rows of their own side once, by blocks of that side's ids, and each task
reads the rows of the other side batch by batch from files under the shared folder. What is written and shuffled is every
factor row once each and every rating once a side, whatever the number of blocks; what is read grows with blocks times rows.

Rows may lie in slices ``(side, id, shard, features)``: no exchange carries more than a slice then. The files are opened by the
tasks themselves, so the shared folder must be one that ``coo_binary.open_path`` reaches, as for binary files.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.functions.arrays import sum_arrays
from ratingloom.functions.mixing import block_of
from ratingloom.operators.factors import ITEM, USER, side_of, stepped_features
from ratingloom.operators.skew import stage_hot_keys
from ratingloom.plans import exchange
from ratingloom.session import Folder, StagedTable, stage, task_slots
from ratingloom.sources import coo_binary

# What a task holds at most, if ids are spread evenly: factor rows of its side (and as much of gradients), and ratings.
MAX_OWN_BYTES = 128 << 20
MAX_OWN_RECORDS = 4_000_000
# An id below this many ratings stays in one block.
MIN_SPLIT_RECORDS = 10_000
# Bytes of features that a task reads at a time.
READ_BYTES = 4 << 20

KEYS = {USER: "user_id", ITEM: "item_id"}


def num_blocks(num_records: int, own_bytes: int, slots: int) -> int:
    """Blocks of a side: of bounded size, and as many for each task slot, so that none works alone at the end."""
    return slots * max(1, math.ceil(num_records / (MAX_OWN_RECORDS * slots)), math.ceil(own_bytes / (MAX_OWN_BYTES * slots)))


@dataclass
class Sizes:
    """Ratings, and the factor rows or slices of each side."""

    records: int
    rows: dict[int, int]


class _Part:
    """The factor rows and ratings of a block. Ratings are sorted by the id of the other side."""

    def __init__(self, batches):
        rows, records = [], []
        for batch in batches:
            is_row = batch.column("features").is_valid()
            if is_row.true_count:
                part = batch.filter(is_row)
                own, lists = part.column("own").to_numpy(), part.column("features")
                rows += [(shard, own[here], _matrix(lists, here)) for shard, here in _by_shard(part.column("shard").to_numpy())]
            if is_row.true_count < batch.num_rows:
                part = batch.filter(pc.invert(is_row))
                names = [name for name in ("own", "other", "rating", "rec_id") if name in part.schema.names]
                records.append({name: part.column(name).to_numpy(zero_copy_only=False) for name in names}
                               | {"rated": part.column("rating").is_valid().to_numpy(zero_copy_only=False)})
        self.keys = np.unique(np.concatenate([np.zeros(0, np.int32), *(own for _, own, _ in rows)]))
        self.features = {}
        while rows:
            shard, own, values = rows.pop()
            if shard not in self.features:
                self.features[shard] = np.zeros((len(self.keys), values.shape[1]), values.dtype)
            self.features[shard][np.searchsorted(self.keys, own)] = values
        self._order(records)

    def _order(self, records: list[dict]) -> None:
        columns = {name: np.concatenate([r.pop(name) for r in records]) for name in list(records[0])} if records else {}
        if not columns or len(self.keys) == 0:
            self.place = self.other = np.zeros(0, np.int32)
            self.rating, self.rated, self.rec_id = np.zeros(0), np.zeros(0, bool), np.zeros(0, np.int64)
            return
        own = columns.pop("own")
        place = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        known = np.flatnonzero(self.keys[place] == own)
        order = known[np.argsort(columns["other"][known], kind="stable")]
        self.place = place[order].astype(np.int32)
        self.other, self.rating, self.rated = (columns.pop(name)[order] for name in ("other", "rating", "rated"))
        self.rec_id = columns["rec_id"][order] if "rec_id" in columns else None


def _by_shard(shards: np.ndarray) -> list[tuple[int, np.ndarray]]:
    return [(int(shard), np.flatnonzero(shards == shard)) for shard in np.unique(shards)]


def _matrix(lists: pa.Array, rows: np.ndarray) -> np.ndarray:
    """The given rows of a list column, all of one length, as an array."""
    chosen = lists if len(rows) == len(lists) else lists.take(pa.array(rows))
    return chosen.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


class StreamedScore:
    """The work of a task on the ratings and rows of its block; ``files`` hold the rows of the other side."""

    def __init__(self, files: list[str], width: int, gaps: bool = False):
        self.files = files
        self.gaps = gaps
        self.rows = max(1, READ_BYTES // (8 * max(1, width)))
        self.chunk = max(1, exchange.SCORE_BYTES // (8 * max(1, width)))

    def _meet(self, part: _Part):
        """``(shard, ratings, rows of the other side)`` for all ratings of the part, some at a time."""
        import pyarrow.parquet as pq
        if not len(part.other):
            return
        others, starts = np.unique(part.other, return_index=True)
        counts = np.diff(np.append(starts, len(part.other)))
        for path in self.files:
            system, plain = coo_binary.open_path(path)
            with system.open_input_file(plain) as file:
                for batch in pq.ParquetFile(file, buffer_size=1 << 20).iter_batches(self.rows, use_threads=False):
                    ids = batch.column("id").to_numpy()
                    found = np.minimum(np.searchsorted(others, ids), len(others) - 1)
                    met = np.flatnonzero(others[found] == ids)
                    for shard, chosen in _by_shard(batch.column("shard").to_numpy()[met]):
                        here = met[chosen]
                        values = _matrix(batch.column("features"), here)
                        first, many = starts[found[here]], counts[found[here]]
                        rows = np.repeat(np.arange(len(here)), many)
                        ratings = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many - first, many)
                        for begin in range(0, len(rows), self.chunk):
                            some = slice(begin, begin + self.chunk)
                            yield shard, ratings[some], values[rows[some]]

    def _scored(self, part: _Part) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of the ratings, and which of them have both rows."""
        total, met = np.zeros(len(part.other)), np.zeros(len(part.other), bool)
        for shard, ratings, q in self._meet(part):
            total[ratings] += exchange._dots(part.features[shard][part.place[ratings]], q)
            met[ratings] = True
        return total, met

    def predictions(self, batches):
        """``rec_id, own, other, rating, prediction`` of the ratings that the model covers."""
        part = _Part(batches)
        total, met = self._scored(part)
        covered = np.flatnonzero(met)
        for begin in range(0, len(covered), exchange.SCORE_CHUNK):
            some = covered[begin:begin + exchange.SCORE_CHUNK]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.rec_id[some]), pa.array(part.keys[part.place[some]]), pa.array(part.other[some]),
                 pa.array(part.rating[some], mask=~part.rated[some]), pa.array(total[some])],
                names=["rec_id", "own", "other", "rating", "prediction"])

    def gradients(self, batches):
        """``id, shard, features, gradient, square, rated``: all rows of the block, those without ratings with no gradient.

        With ``gaps`` a row all of whose ratings are null has a gradient of nulls, else none.
        """
        part = _Part(batches)
        # Slices are scored before any gradient is known; whole rows in the same reading.
        total = self._scored(part)[0] if len(part.features) > 1 else None
        sums = {shard: np.zeros(rows.shape) for shard, rows in part.features.items()}
        touched, rated = np.zeros((2, len(part.keys)), bool)
        squares, number = 0.0, 0
        for shard, ratings, q in self._meet(part):
            touched[part.place[ratings]] = True
            sure = part.rated[ratings]
            if not sure.all():
                ratings, q = ratings[sure], q[sure]
            if not len(ratings):
                continue
            own = part.place[ratings]
            score = exchange._dots(part.features[shard][own], q) if total is None else total[ratings]
            error = score - part.rating[ratings]
            if shard == min(sums):
                squares += float(error @ error)
                number += len(error)
            _add(sums[shard], own, error[:, None] * q)
            rated[own] = True
        if not self.gaps:
            touched = rated
        for shard in sorted(sums):
            for begin in range(0, len(part.keys), self.rows):
                some = slice(begin, begin + self.rows)
                # The errors of the part stand in its first row.
                first = shard == min(sums) and begin == 0
                ids = part.keys[some]
                square, known = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
                square[:1], known[:1] = (squares, number) if first else (0.0, 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(np.full(len(ids), shard, np.int32)), exchange.list_column(part.features[shard][some]),
                     _gradient_column(sums[shard][some], touched[some], rated[some]), pa.array(square), pa.array(known)],
                    names=["id", "shard", "features", "gradient", "square", "rated"])


def _add(sums: np.ndarray, places: np.ndarray, terms: np.ndarray) -> None:
    """Add each term to the row at its place; most places come once."""
    found, first = np.unique(places, return_index=True)
    sums[found] += terms[first]
    if len(found) < len(places):
        again = np.delete(np.arange(len(places)), first)
        again = again[np.argsort(places[again], kind="stable")]
        found, starts = np.unique(places[again], return_index=True)
        sums[found] += np.add.reduceat(terms[again], starts, axis=0)


def _gradient_column(sums: np.ndarray, touched: np.ndarray, rated: np.ndarray) -> pa.Array:
    rows, width = sums.shape
    offsets = pa.array(np.arange(0, rows * width + 1, width), pa.int32())
    values = pa.array(sums.reshape(-1), mask=None if rated.all() else np.repeat(~rated, width))
    return pa.ListArray.from_arrays(offsets, values, mask=pa.array(~touched))


class StreamedRows:
    """Factor rows or slices written once a side, in files that every task may read."""

    def __init__(self, tables: dict[int, StagedTable], width: int):
        self.tables = tables
        self.width = width

    @classmethod
    def of(cls, rows: DataFrame, width: int, sides: tuple[int, ...] = (USER, ITEM)) -> StreamedRows:
        """``rows`` has ``side, id, features`` and, if these are slices of at most ``width`` values, ``shard``."""
        whole = rows if "shard" in rows.columns else rows.withColumn("shard", F.lit(0))
        return cls({side: stage(side_of(whole, side).select(F.col("id").cast("int").alias("id"), "shard", "features"), "streamed-rows") for side in sides}, width)

    def rows(self, side: int) -> DataFrame:
        return self.tables[side].df

    def _score(self, side: int, gaps: bool = False) -> StreamedScore:
        table = self.tables[side]
        return StreamedScore(coo_binary._files(Folder(table.df.sparkSession, table.path).uri), self.width, gaps)


def _records(ratings: DataFrame, side: int) -> DataFrame:
    # An id beyond 31 bits is none of the model's.
    ids = [F.col(key).try_cast("int").alias(name) for key, name in ((KEYS[side], "own"), (KEYS[1 - side], "other"))]
    named = ratings.select(*ids, F.col("rating").cast("double").alias("rating"), F.col("rec_id").cast("long").alias("rec_id"))
    return named.where(F.col("own").isNotNull() & F.col("other").isNotNull())


def _hot(ratings: DataFrame, side: int, blocks: int) -> DataFrame | None:
    """``(own, copies)`` of the ids above 1/(2 * blocks) of the ratings, fewer than that; None without any."""
    found = stage_hot_keys(ratings, KEYS[side], min_rows=MIN_SPLIT_RECORDS, max_keys=2 * blocks)
    return found and F.broadcast(found.df.select(F.col(KEYS[side]).try_cast("int").alias("own"), "copies"))


def _blocks(records: DataFrame, rows: DataFrame, blocks: int, hot: DataFrame | None, *carry: str) -> DataFrame:
    """Ratings (without features) and factor rows (with them), one partition a block. Hot ids lie in several blocks."""
    rows = rows.select(F.col("id").cast("int").alias("own"), "shard", "features")
    copy = F.lit(0)
    if hot is not None:
        records = records.join(hot, "own", "left").withColumn("copy", F.coalesce(F.pmod(F.xxhash64("rec_id"), "copies"), F.lit(0)))
        rows = rows.join(hot, "own", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)))
        copy = F.col("copy")
    part = F.pmod(block_of(F.col("own"), copy, blocks), F.lit(blocks)).alias("part")
    met = records.select(part, "own", "other", "rating", *carry).unionByName(
        rows.select(part, "own", "shard", "features"), allowMissingColumns=True)
    return met.repartitionById(blocks, "part").drop("part")


def predictions(ratings: DataFrame, state: DataFrame, sizes: Sizes, width: int) -> DataFrame:
    """``(rec_id, user_id, item_id, rating, prediction, residual)`` of the records the model covers."""
    blocks = {side: num_blocks(sizes.records, sizes.rows[side] * width * 8, task_slots(ratings.sparkSession)) for side in KEYS}
    # The side at hand is the one whose blocks need less of the other side to be read.
    side = min(KEYS, key=lambda s: blocks[s] * sizes.rows[1 - s])
    store = StreamedRows.of(state, width, (1 - side,))
    own = side_of(state if "shard" in state.columns else state.withColumn("shard", F.lit(0)), side)
    score = store._score(1 - side)

    def run(batches):
        return score.predictions(batches)

    met = _blocks(_records(ratings, side), own, blocks[side], _hot(ratings, side, blocks[side]), "rec_id")
    scored = met.mapInArrow(run, "rec_id long, own int, other int, rating double, prediction double")
    kinds = ratings.select("rec_id", "user_id", "item_id", "rating").schema
    named = scored.withColumnsRenamed({"own": KEYS[side], "other": KEYS[1 - side]})
    return named.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds), "prediction",
                        (F.col("prediction") - F.col("rating")).alias("residual"))


def _side_gradients(ratings: DataFrame, store: StreamedRows, rows: DataFrame, side: int, blocks: int, hot: DataFrame | None,
                    gaps: bool) -> DataFrame:
    """``(side, id, shard, features, gradient, square, rated)`` of all ``rows`` of a side; the last two on rows of users."""
    score = store._score(1 - side, gaps)
    kind = rows.schema["features"].dataType.simpleString()

    def run(batches):
        return score.gradients(batches)

    done = _blocks(_records(ratings, side), rows, blocks, hot).mapInArrow(
        run, f"id int, shard int, features {kind}, gradient array<double>, square double, rated long")
    known = [F.col(c) if side == USER else F.lit(None).cast(t).alias(c) for c, t in (("square", "double"), ("rated", "long"))]
    return done.select(F.lit(side).alias("side"), "id", "shard", "features", "gradient", *known)


def epoch(ratings: DataFrame, store: StreamedRows, num_records: int, learning_rate: float, regularization: float,
          precision: str = "double", gaps: bool = False) -> DataFrame:
    """One batch step: ``(side, id, shard, features, square, rated)``, all rows of ``store``.

    A block knows the whole gradient of its ids, so rows move where they were summed. Only hot ids, few by
    definition, are summed over blocks and joined with their rows.
    """
    result, step = None, stepped_features(learning_rate, regularization, precision)
    for side in (USER, ITEM):
        rows = store.rows(side)
        blocks = num_blocks(num_records, rows.count() * store.width * 8, task_slots(ratings.sparkSession))
        hot = _hot(ratings, side, blocks)
        if hot is None:
            moved = _side_gradients(ratings, store, rows, side, blocks, None, gaps).withColumn("features", step)
        else:
            def chosen(how):
                return [table.join(hot.select(F.col("own").alias(key)), key, how) for table, key in ((ratings, KEYS[side]), (rows, "id"))]

            (most_ratings, most_rows), (few_ratings, few_rows) = chosen("left_anti"), chosen("left_semi")
            moved = _side_gradients(most_ratings, store, most_rows, side, blocks, None, gaps).withColumn("features", step)
            parts = _side_gradients(few_ratings, store, few_rows, side, blocks, hot, gaps)
            # A shorter last slice is filled up, so that all can be summed alike.
            missing = F.array_repeat(F.lit(0.0).cast("double"), F.lit(store.width) - F.size("gradient"))
            few = parts.where(F.col("gradient").isNotNull()).withColumn("gradient", F.concat("gradient", missing))
            sums = sum_arrays(few, ["id", "shard"], "gradient", store.width, [F.sum("square").alias("square"), F.sum("rated").alias("rated")])
            joined = few_rows.join(sums.hint("shuffle_hash"), ["id", "shard"], "left").withColumn(
                "gradient", F.slice("gradient", 1, F.size("features")))
            moved = moved.unionByName(joined.select(F.lit(side).alias("side"), *moved.columns[1:]).withColumn("features", step))
        result = moved if result is None else result.unionByName(moved)
    return result.drop("gradient")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
for _module in (exchange, coo_binary):
    cloudpickle.register_pickle_by_value(_module)
