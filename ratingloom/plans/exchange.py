"""Arrow in, numpy in the middle, Arrow out: the body of every block task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ratingloom.plans import kernels

USER, ITEM = 0, 1
# Records scored at a time, fewer if their rows are wide; bounds the temporary arrays of a part.
SCORE_CHUNK = 1 << 16
SCORE_BYTES = 4 << 20


def matrix(table: pa.Table, column: str, width: int) -> np.ndarray:
    """A list column, or packed rows of two bytes a value, as a writable ``(rows, width)`` array."""
    rows = table.column(column).combine_chunks()
    if pa.types.is_binary(rows.type):
        return packed_values(rows).reshape(-1, width).astype(np.float32)
    return np.array(rows.flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)


def packed_values(rows: pa.BinaryArray) -> np.ndarray:
    """The binary16 values of packed rows, one after the other."""
    if len(rows) == 0:
        return np.zeros(0, np.float16)
    offsets = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset: rows.offset + len(rows) + 1]
    return np.frombuffer(rows.buffers()[2], np.uint8)[offsets[0]: offsets[-1]].view(np.float16)


def packed_column(values: np.ndarray) -> pa.Array:
    """Rows of binary16 values as buffers of two bytes a value."""
    rows, width = values.shape
    offsets = np.arange(0, 2 * rows * width + 1, 2 * width, dtype=np.int32) if rows and width else np.zeros(rows + 1, np.int32)
    data = np.ascontiguousarray(values, np.float16)
    return pa.BinaryArray.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def list_column(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    offsets = pa.array(np.arange(0, rows * width + 1, width), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1)))


class BlockUpdate:
    """Applies one update rule to the factor rows and ratings that met in a block.

    ``state`` tables have ``side``, ``key``, ``features`` and, for adaptive descent, ``acc``;
    ``records`` tables have ``user_key``, ``item_key``, ``rating``, ``pos`` and ``wave``.
    The other columns of ``state`` pass through.
    """

    def __init__(self, rule: str, width: int, rate: float, penalty: float, precision: str, batch_size: int = 1):
        self.rule = rule
        self.width = width
        self.rate = rate
        self.penalty = penalty
        self.precision = precision
        self.batch_size = batch_size

    @property
    def lists(self) -> dict[str, int]:
        """The list columns of the state and how long they are."""
        return {"features": self.width, **({"acc": self.width} if self.rule == "adagrad" else {})}

    def __call__(self, state: pa.Table, records: pa.Table) -> pa.Table:
        if records.num_rows == 0:
            return self._with_lists(state, {})
        sides = state.column("side").to_numpy()
        keys = state.column("key").to_numpy()
        changed = {name: matrix(state, name, width) for name, width in self.lists.items()}
        rows = {side: np.flatnonzero(sides == side) for side in (USER, ITEM)}
        for side in rows:
            rows[side] = rows[side][np.argsort(keys[rows[side]])]
        users = self._locate(keys[rows[USER]], records.column("user_key").to_numpy())
        items = self._locate(keys[rows[ITEM]], records.column("item_key").to_numpy())
        halves = {name: (values[rows[USER]], values[rows[ITEM]]) for name, values in changed.items()}
        self._descend(halves, users, items, records)
        for name, (p, q) in halves.items():
            changed[name][rows[USER]], changed[name][rows[ITEM]] = p, q
        return self._with_lists(state, changed)

    def _descend(self, halves: dict, users: np.ndarray, items: np.ndarray, records: pa.Table) -> None:
        """Change the user and item arrays in ``halves`` in place."""
        ratings = records.column("rating").to_numpy().astype(kernels.arithmetic_type(self.precision))
        p, q = halves["features"]
        if self.rule == "minibatch":
            order = np.argsort(records.column("pos").to_numpy(), kind="stable")
            kernels.batched(p, q, users[order], items[order], ratings[order], self.batch_size,
                            self.rate, self.penalty, self.precision)
        else:
            kernels.sequential(p, q, *halves.get("acc", (None, None)), users, items, ratings,
                               records.column("wave").to_numpy(), self.rate, self.penalty, self.precision,
                               self.rule == "adagrad")

    @staticmethod
    def _locate(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        found = np.searchsorted(known, wanted)
        if len(known) == 0 or (known[np.minimum(found, len(known) - 1)] != wanted).any():
            raise ValueError("a rating refers to an id outside the factor table")
        return found

    def _with_lists(self, state: pa.Table, changed: dict[str, np.ndarray]) -> pa.Table:
        """Output columns; lists are rebuilt so that their element type is always nullable."""
        columns = {}
        for name in state.column_names:
            packed = pa.types.is_binary(state.schema.field(name).type)
            if name in changed:
                columns[name] = packed_column(changed[name]) if packed else list_column(changed[name])
            elif pa.types.is_list(state.schema.field(name).type):
                columns[name] = list_column(matrix(state, name, self.lists[name]))
            else:
                columns[name] = state.column(name)
        return pa.table(columns)


class RunsUpdate(BlockUpdate):
    """Several runs' updates on factor rows that hold all runs' features one after the other.

    ``features`` holds every run's, ``acc`` those of the adaptive runs, both in the order of ``updates``.
    """

    def __init__(self, updates: list[BlockUpdate]):
        self.updates = updates

    @property
    def lists(self) -> dict[str, int]:
        sums = sum(u.width for u in self.updates if u.rule == "adagrad")
        return {"features": sum(u.width for u in self.updates), **({"acc": sums} if sums else {})}

    def _descend(self, halves: dict, users: np.ndarray, items: np.ndarray, records: pa.Table) -> None:
        begins = dict.fromkeys(halves, 0)
        for update in self.updates:
            kind = kernels.arithmetic_type(update.precision)
            slices = {}
            for name in update.lists:
                slices[name] = slice(begins[name], begins[name] + update.width)
                begins[name] += update.width
            own = {name: tuple(half[:, part].astype(kind) for half in halves[name]) for name, part in slices.items()}
            update._descend(own, users, items, records)
            for name, part in slices.items():
                for half, moved in zip(halves[name], own[name]):
                    half[:, part] = moved


class BlockScore:
    """Scores the ratings of a part against its factor rows, without changing them.

    ``gradients`` gives each touched row's gradient sum, ``errors`` one row with the squared
    error sum and the record count of the part, ``predictions`` the score of every record.
    Records of ids outside the model are left out of all three.
    """

    def __init__(self, width: int):
        self.width = width
        self.chunk = max(1, min(SCORE_CHUNK, SCORE_BYTES // (8 * max(1, width))))

    def _rows(self, state: pa.Table) -> tuple[np.ndarray, dict]:
        """The features of a part, and for each side its sorted keys with their places."""
        sides = state.column("side").to_numpy()
        keys = state.column("key").to_numpy()
        rows = {}
        for side in (USER, ITEM):
            places = np.flatnonzero(sides == side)
            places = places[np.argsort(keys[places])]
            rows[side] = keys[places], places
        return matrix(state, "features", self.width), rows

    def _scored(self, rows: dict, records: pa.Table, rated: bool = True):
        """Records in chunks, with the feature rows of their users and items; no array is as long as the part."""
        for batch in records.to_batches(max_chunksize=self.chunk):
            found = np.ones(batch.num_rows, dtype=bool)
            if rated:
                found &= batch.column("rating").is_valid().to_numpy(zero_copy_only=False)
            places = {}
            for side, column in ((USER, "user_key"), (ITEM, "item_key")):
                known, where = rows[side]
                wanted = batch.column(column).to_numpy(zero_copy_only=False)
                if len(known) == 0:
                    found[:] = False
                    break
                places[side] = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                found &= known[places[side]] == wanted
            if found.any():
                yield (batch.filter(pa.array(found)), *(rows[side][1][places[side][found]] for side in (USER, ITEM)))

    def gradients(self, state: pa.Table, records: pa.Table) -> pa.Table:
        features, rows = self._rows(state)
        total = np.zeros(features.shape)
        touched = np.zeros(len(features), dtype=bool)
        squares, number = 0.0, 0
        for batch, u, i in self._scored(rows, records):
            p, q = features[u], features[i]
            error = (_dots(p, q) - batch.column("rating").to_numpy())[:, None]
            squares += float(error[:, 0] @ error[:, 0])
            number += len(u)
            for target, term in ((u, error * q), (i, error * p)):
                order = np.argsort(target, kind="stable")
                ids, starts = np.unique(target[order], return_index=True)
                total[ids] += np.add.reduceat(term[order], starts, axis=0)
                touched[ids] = True
        touched = np.flatnonzero(touched)
        # The errors of the part stand in its first row.
        square, rated = np.zeros(len(touched)), np.zeros(len(touched), np.int64)
        square[:1], rated[:1] = squares, number
        return pa.table({"side": state.column("side").take(touched), "key": state.column("key").take(touched),
                         "gradient": list_column(total[touched]), "square": square, "rated": rated})

    def predictions(self, state: pa.Table, records: pa.Table) -> pa.Table:
        features, rows = self._rows(state)
        columns = ["rec_id", "user_key", "item_key", "rating"]
        kept = [pa.Table.from_batches([batch.select(columns)]).append_column("prediction", pa.array(_dots(features[u], features[i])))
                for batch, u, i in self._scored(rows, records, rated=False)]
        none = records.schema.empty_table().select(columns).append_column("prediction", pa.array([], pa.float64()))
        return pa.concat_tables([none, *kept])

    def errors(self, state: pa.Table, records: pa.Table) -> pa.Table:
        features, rows = self._rows(state)
        squares, number = 0.0, 0
        for batch, u, i in self._scored(rows, records):
            error = _dots(features[u], features[i]) - batch.column("rating").to_numpy()
            squares += float(error @ error)
            number += len(error)
        return pa.table({"square_error_sum": pa.array([squares]), "num_records": pa.array([number], pa.int64())})


def _dots(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row-wise inner products: products in the storage type, sums in double."""
    return np.sum(p * q, axis=1, dtype=np.float64)


def add_waves(records: pa.Table) -> pa.Table:
    """Add the wave number of each record of a block, for the serial order by ``pos``."""
    order = np.argsort(records.column("pos").to_numpy(), kind="stable")
    waves = np.empty(len(order), dtype=np.int32)
    users, items = records.column("user_key").to_numpy(), records.column("item_key").to_numpy()
    waves[order] = kernels.wave_numbers(users[order], items[order])
    return records.append_column("wave", pa.array(waves))
