"""Repair of conversation structure by aligning turns with an alternating target string.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles. The repair with the least
cost is found by aligning its turns with every feasible length of the alternating string: a
Wagner-Fischer table over turns and target characters counted from the end, which all lengths
share, confined to Ukkonen's band: cells that the cost of a plain left-to-right repair, the
incumbent, can't rule out. Audits are traced back for every length of least cost, and the least is taken.

Long conversations are cut into segments of at most ``SEGMENT`` turns. A segment is aligned for each
state that can stand before it and after it (nothing written, system, user, assistant); a path
through the segments then costs the sum of theirs. Two repairs of one segment between the same states with
the same cost are never prefixes of one another, so the least audit of a whole is made of least audits of its parts.

Rows go by ranges of (conversation, turn) to tasks, so a conversation may span many of them. Memory is bounded by
a segment; only the audit itself and one number a segment grow with a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratingloom.session import stage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SEGMENT = 512
SEGMENT_BYTES = 4 << 20
#: Table cells that are aligned at a time.
CELLS = 1 << 21
#: States before and after a segment; the number of a role's initial, or of nothing written yet.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_OTHER = 4
_FAR = 1 << 40
_BLANKS = r"\x20\x09-\x0D"


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies)``: rows damaged by ``crc32('conv_id:turn') % 20``.

    Nulls in the key, in roles and in texts are read as one blank; dropped rows have no copies and nulls.
    """
    def plain(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))
    code = F.crc32(F.concat_ws(":", plain("conv_id"), plain("turn")).cast("binary")) % 20
    text = (F.when(code == 1, F.lit("")).when(code == 2, F.regexp_replace(plain("text"), "[.!?]", ""))
            .otherwise(plain("text")))
    role = F.when(code == 4, F.lit("user")).otherwise(plain("role"))
    copies = F.when(code == 0, 0).when(code == 3, 2).otherwise(1)
    # A dropped row only says that its conversation is there.
    return conversations.select(
        F.col("`conv_id`").cast("long").alias("conv_id"), F.when(code != 0, F.col("`turn`").cast("long")).alias("turn"),
        F.when(code != 0, role).alias("role"), F.when(code != 0, text).alias("text"), copies.cast("long").alias("copies"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn together, with ``copies``, ``blank``, ``seen`` (an earlier turn has role and text) and ``open_end``."""
    together = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    earlier = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    last = F.regexp_extract("text", rf"([^{_BLANKS}])[{_BLANKS}]*\z", 1)
    return together.select("*", (last == "").alias("blank"), (F.row_number().over(earlier) > 1).alias("seen"),
                           (~last.isin(".", "!", "?")).alias("open_end"))


@dataclass
class Turns:
    """Turns of one segment: initials, cost of keeping (``_FAR`` for those that must go), copies of those."""

    initials: np.ndarray
    keep: np.ndarray
    copies: np.ndarray

    @property
    def forced(self) -> np.ndarray:
        return self.keep >= _FAR


def rows_of(initials: np.ndarray, blank: np.ndarray, seen: np.ndarray, open_end: np.ndarray, copies: np.ndarray) -> Turns:
    """One entry for a row that may stay and one, with its copies, for those that have to go."""
    fresh = ~(blank | seen)
    more = fresh & (copies > 1)
    order = np.repeat(np.arange(len(initials)), 1 + more)
    again = np.zeros(len(order), dtype=bool)
    again[np.flatnonzero(more) + np.cumsum(more)[more]] = True
    keep = np.where(fresh, np.where(open_end, TRUNCATED, KEEP), _FAR)[order]
    keep[again] = _FAR
    count = np.where(fresh[order] & ~again, 1, np.where(again, copies[order] - 1, copies[order]))
    return Turns(initials[order], keep, count)


class Alignment:
    """Tables of segments of equal length (shorter ones padded in front), counted from the end of the target.

    ``cost[i][k, r]`` is the least cost of writing the last ``r`` characters of the alternating string that
    ends in ``last`` with the rows from ``i`` on; cells outside the band hold ``_FAR``.
    """

    def __init__(self, segments: list[Turns], last: int, incumbents: np.ndarray):
        self.last = last
        length = max(len(s.initials) for s in segments)
        self.pads = [length - len(s.initials) for s in segments]
        self.initials = np.full((len(segments), length), _OTHER)
        self.keep = np.full((len(segments), length), _FAR)
        self.delete = np.zeros((len(segments), length), np.int64)
        for k, s in enumerate(segments):
            self.initials[k, self.pads[k]:] = s.initials
            self.keep[k, self.pads[k]:] = s.keep
            self.delete[k, self.pads[k]:] = DELETE * s.copies
        forced = self.keep >= _FAR
        behind = np.cumsum(~forced[:, ::-1], axis=1)[:, ::-1]
        behind = np.concatenate([behind, np.zeros((len(segments), 1), np.int64)], axis=1)
        spare = incumbents - np.where(forced, self.delete, 0).sum(axis=1)
        fewer, more = spare // DELETE, spare // INSERT
        # At most one inserted turn goes before each row that stays, and one or two at either end.
        width = int(np.minimum(behind[:, 0] + more, 2 * behind[:, 0] + 3).max()) + 1
        places = np.arange(width)
        # The r-th character from the end.
        self.wanted = np.where(places % 2 == 1, last, USER + ASSISTANT - last)
        self.cost = [None] * (length + 1)
        self.cost[length] = np.tile(INSERT * places, (len(segments), 1))
        for i in range(length - 1, -1, -1):
            after = self.cost[i + 1]
            kept = np.where(self.initials[:, i: i + 1] == self.wanted[1:], KEEP, REROLE)
            stay = np.minimum(self.keep[:, i: i + 1] + kept + after[:, :-1], _FAR)
            best = after + self.delete[:, i: i + 1]
            best[:, 1:] = np.minimum(best[:, 1:], stay)
            best = INSERT * places + np.minimum.accumulate(best - INSERT * places, axis=1)
            low, high = behind[:, i] - fewer, behind[:, i] + more
            best[(places < low[:, None]) | (places > high[:, None])] = _FAR
            self.cost[i] = np.minimum(best, _FAR)

    def audit(self, segment: int, row: int, left: int) -> str:
        """The least string of edits among the cheapest from ``row`` on with ``left`` characters to write."""
        keep, delete, initials = self.keep[segment], self.delete[segment], self.initials[segment]
        length, edits = len(keep), []
        while row < length or left:
            now = self.cost[row][segment, left]
            if row < length and now == delete[row] + self.cost[row + 1][segment, left]:
                edits.append("D" * (delete[row] // DELETE))
                row += 1
            elif left and now == INSERT + self.cost[row][segment, left - 1]:
                edits.append("I")
                left -= 1
            else:
                edits.append("K" if initials[row] == self.wanted[left] else "R")
                row += 1
                left -= 1
        return "".join(edits)


def _incumbents(segments: list[Turns]) -> np.ndarray:
    """Upper bounds of the least cost between any two states: a plain repair from left to right, and its ends mended."""
    bounds = []
    for s in segments:
        forced = s.forced
        initials, keep = s.initials[~forced], s.keep[~forced]
        wanted = np.where(np.arange(len(initials)) % 2 == 0, USER, ASSISTANT)
        reroled = min(int((initials != wanted).sum()), int((initials != USER + ASSISTANT - wanted).sum()) + 1)
        bounds.append(DELETE * int(s.copies[forced].sum()) + int(keep.sum()) + REROLE * reroled + 3 * INSERT)
    return np.array(bounds, np.int64)


def _less(a, b):
    return b if a is None or (b is not None and b < a) else a


def align(segments: list[Turns], entries: list[tuple[int, ...]], exits: list[tuple[int, ...]]) -> list[dict]:
    """For each segment the cheapest ``(cost, audit)`` by states before and after it, least audit among equals."""
    results: list[dict] = [{} for _ in segments]
    bounds = _incumbents(segments)
    for last in (ASSISTANT, USER):
        chosen = [k for k in range(len(segments)) if last in exits[k]]
        if not chosen:
            continue
        table = Alignment([segments[k] for k in chosen], last, bounds[chosen])
        for at, k in enumerate(chosen):
            for entry in entries[k]:
                best = _best_length(table, at, entry)
                if best is not None:
                    results[k][entry, last] = best
    for k, s in enumerate(segments):
        gone = DELETE * int(s.copies.sum()), "D" * int(s.copies.sum())
        for state in (NOTHING, SYSTEM):
            if state in entries[k] and state in exits[k]:
                results[k][state, state] = gone
        if NOTHING in entries[k] and SYSTEM in exits[k]:
            best = None
            for row in np.flatnonzero((s.initials == SYSTEM) & ~s.forced).tolist():
                before, after = int(s.copies[:row].sum()), int(s.copies[row + 1:].sum())
                best = _less(best, (DELETE * (before + after) + int(s.keep[row]), "D" * before + "K" + "D" * after))
            if best is not None:
                results[k][NOTHING, SYSTEM] = best
    return results


def _best_length(table: Alignment, at: int, entry: int) -> tuple[int, str] | None:
    """Compare the feasible lengths from one state: the cheapest, and of these the least audit."""
    first, width = table.pads[at], table.cost[0].shape[1]
    follows = ASSISTANT if entry == USER else USER
    # Lengths whose first character may follow the state; none at all where it is the last one already.
    lengths = np.array([0] * (entry == table.last) + [r for r in range(1, width) if table.wanted[r] == follows])
    begins = [(0, first, "")]
    if entry == NOTHING:
        # Delete up to a system row, keep it, then the same lengths behind it.
        initials, keep, before = table.initials[at], table.keep[at], 0
        for row in range(first, len(initials)):
            if initials[row] == SYSTEM and keep[row] < _FAR:
                begins.append((before + int(keep[row]), row + 1, "D" * (before // DELETE) + "K"))
            before += int(table.delete[at, row])
    costs = [cost + table.cost[row][at][lengths] if len(lengths) else np.array([_FAR]) for cost, row, _ in begins]
    least = min(int(c.min()) for c in costs)
    if least >= _FAR:
        return None
    return least, min(start + table.audit(at, row, int(r)) for (_, row, start), c in zip(begins, costs)
                      for r in lengths[c == least])


def written(audit: str, state: int, roles: list, texts: list, copies: list) -> list[tuple[str, str]]:
    """The repaired ``(role, text)`` turns of an audit from a state."""
    turns, row, used = [], 0, 0
    for edit in audit:
        role = text = ""
        if edit != "I":
            role, text = roles[row], texts[row]
            used += 1
            if used == copies[row]:
                row, used = row + 1, 0
        if edit == "D":
            continue
        if edit == "K":
            state = _INITIALS[role[:1]]
        else:
            state = ASSISTANT if state == USER else USER
            role = ("user", "assistant")[state - USER]
        turns.append((role, text))
    return turns


_STATES = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
#: A segment, or a whole conversation: then ``audit`` is set and ``roles`` and ``texts`` are the repaired ones.
_SEGMENT = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("number", pa.int64()),
    ("distinct_turns", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()),
    ("first_initial", pa.int32()), ("last_initial", pa.int32()),
    ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("copies", pa.list_(pa.int64())),
    ("states", _STATES), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_CHOSEN = pa.schema([("part", pa.int64()), ("number", pa.int64()), ("entry", pa.int32()), ("cost", pa.int64()),
                     ("audit", pa.string())])
_RESULT = pa.schema([
    ("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
    ("repaired_sha256", pa.string())])
_TURN = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("number", pa.int64()), ("line", pa.int32()),
                   ("role", pa.string()), ("text", pa.string())])
_WHOLE = ((NOTHING,), (NOTHING, ASSISTANT))
_ANY = ((NOTHING, SYSTEM, USER, ASSISTANT),) * 2


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


@dataclass
class _Segments:
    """Cuts sorted rows into segments and aligns them.

    A conversation that is whole in one segment is repaired at once. The first and the last one of a task may
    go on in another task; these and long ones keep the costs between all states.
    """

    turns: int = SEGMENT
    text_bytes: int = SEGMENT_BYTES

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        waiting, cells, held_bytes = [], 0, 0
        for number, (conv_id, rows, whole, size) in enumerate(self.pieces(batches)):
            waiting.append((conv_id, part, number, rows, whole))
            cells += (len(rows) + 1) * (2 * len(rows) + 4)
            held_bytes += size
            if cells > CELLS or held_bytes > self.text_bytes:
                yield self.solved(waiting)
                waiting, cells, held_bytes = [], 0, 0
        if waiting:
            yield self.solved(waiting)

    def pieces(self, batches):
        """``(conv_id, rows, whole, size)`` in order."""
        held, size, current, started, first, split = [], 0, None, False, True, False
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in
                       ("conv_id", "turn", "role", "text", "copies", "blank", "seen", "open_end"))
            for conv_id, *row in zip(*columns):
                if started and conv_id != current:
                    # The first conversation of a task may have begun in the one before.
                    yield current, held, not (split or first), size
                    held, size, split, first = [], 0, False, False
                elif len(held) >= self.turns or size > self.text_bytes:
                    yield current, held, False, size
                    held, size, split = [], 0, True
                current, started = conv_id, True
                if row[3]:
                    held.append(row)
                    size += len(row[2]) + 50
        if started:
            yield current, held, False, size

    def solved(self, waiting: list) -> pa.RecordBatch:
        facts = [_facts(rows) for _, _, _, rows, _ in waiting]
        turns = [rows_of(*fact) for fact in facts]
        order = sorted(range(len(turns)), key=lambda k: len(turns[k].initials))
        found: list = [None] * len(turns)
        first = 0
        while first < len(order):
            # Segments of about equal length share a table.
            last = first
            while last < len(order):
                length = len(turns[order[last]].initials)
                cells = (last - first + 1) * (length + 1) * (2 * length + 4)
                if last > first and (cells > CELLS or length > 1.25 * len(turns[order[first]].initials) + 2):
                    break
                last += 1
            some = order[first: last]
            kinds = [_WHOLE if waiting[k][4] else _ANY for k in some]
            for k, result in zip(some, align([turns[k] for k in some], [e for e, _ in kinds], [x for _, x in kinds])):
                found[k] = result
            first = last
        return _batch([self.row(*given) for given in zip(waiting, facts, found)], _SEGMENT)

    @staticmethod
    def row(item, fact, states) -> dict:
        conv_id, part, number, rows, whole = item
        initials, blank, seen, open_end, copies = fact
        numbers = [row[0] for row in rows if row[0] is not None]
        fresh = ~(blank | seen)
        made = {
            "conv_id": conv_id, "part": part, "number": number, "distinct_turns": len(set(numbers)),
            "first_turn": numbers[0] if numbers else None, "last_turn": numbers[-1] if numbers else None,
            "first_initial": int(initials[0]) if len(rows) else None,
            "last_initial": int(initials[-1]) if len(rows) else None,
            "blank": int(copies[blank].sum()),
            "duplicate": int(copies[seen & ~blank].sum() + (copies[fresh] - 1).sum()),
            "truncated": int((fresh & open_end).sum()),
            "illegal": int((copies - 1).sum()) + _illegal(initials[:-1], initials[1:])}
        roles, texts = [row[1] for row in rows], [row[2] for row in rows]
        if not whole:
            return made | {"roles": roles, "texts": texts, "copies": copies.tolist(),
                           "states": [{"entry": e, "exit": x, "cost": cost, "audit": audit}
                                      for (e, x), (cost, audit) in states.items()]}
        cost, audit = min(states.values())
        turns = written(audit, NOTHING, roles, texts, copies.tolist())
        text = "\n".join(f"{role}:{text}" for role, text in turns)
        return made | {"roles": [role for role, _ in turns], "texts": [text for _, text in turns], "cost": cost,
                       "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}


def _facts(rows: list) -> tuple:
    """Initials, blank, seen, open end and copies of rows, as arrays."""
    initials = np.array([_INITIALS.get(row[1][:1], _OTHER) for row in rows], np.int64)
    flags = (np.array([row[c] for row in rows], dtype=bool) for c in (4, 5, 6))
    return initials, *flags, np.array([row[3] for row in rows], np.int64)


def _illegal(before: np.ndarray, after: np.ndarray) -> int:
    """Neighbours that are not system before user, user before assistant or assistant before user."""
    legal = (((before == SYSTEM) | (before == ASSISTANT)) & (after == USER)) | ((before == USER) & (after == ASSISTANT))
    return int((~legal).sum())


def _relation(a: str, b: str):
    """-1 or 1 where the order of two strings is settled, else what each has beyond the other."""
    if a.startswith(b) or b.startswith(a):
        return a[len(b):], b[len(a):]
    return -1 if a < b else 1


class _Paths:
    """The cheapest way through the segments so far to each state, and how their audits compare."""

    def __init__(self):
        self.costs = {NOTHING: 0}
        self.nodes = {NOTHING: None}
        self.relations: dict = {}

    def _compare(self, e: int, a: str, f: int, b: str):
        """The audits of the paths to ``e`` and ``f``, followed by ``a`` and ``b``."""
        if e == f:
            return _relation(a, b)
        if e > f:
            found = self._compare(f, b, e, a)
            return -found if isinstance(found, int) else found[::-1]
        known = self.relations[e, f]
        return known if isinstance(known, int) else _relation(known[0] + a, known[1] + b)

    def add(self, part: int, number: int, states: list[dict]) -> None:
        best: dict = {}
        for way in states:
            entry, leave, audit = way["entry"], way["exit"], way["audit"]
            if entry not in self.costs:
                continue
            cost = self.costs[entry] + way["cost"]
            now = best.get(leave)
            if now is None or cost < now[0] or (
                    cost == now[0] and self._compare(entry, audit, now[1], now[2]) == -1):
                best[leave] = cost, entry, audit, way["cost"]
        relations = {(x, y): self._compare(best[x][1], best[x][2], best[y][1], best[y][2])
                     for x in best for y in best if x < y}
        self.nodes = {x: (self.nodes[e], part, number, e, own, audit) for x, (_, e, audit, own) in best.items()}
        self.costs = {x: cost for x, (cost, *_) in best.items()}
        self.relations = relations

    def chosen(self) -> list[dict]:
        """Each segment's state before it, cost and audit, on the cheapest way to nothing or an assistant."""
        ends = [x for x in (NOTHING, ASSISTANT) if x in self.costs]
        end = min(ends, key=lambda x: self.costs[x])
        if len(ends) == 2 and self.costs[NOTHING] == self.costs[ASSISTANT]:
            end = NOTHING if self.relations[NOTHING, ASSISTANT] == -1 else ASSISTANT
        node, rows = self.nodes[end], []
        while node:
            node, part, number, entry, cost, audit = node
            rows.append({"part": part, "number": number, "entry": entry, "cost": cost, "audit": audit})
        return rows[::-1]


def _by_conversation(batches, rows_of_batch):
    """Rows of sorted batches with whether a conversation begins."""
    current, started = None, False
    for batch in batches:
        for row in rows_of_batch(batch):
            yield not started or row["conv_id"] != current, row
            current, started = row["conv_id"], True


def _choose(batches):
    """Rows sorted by conversation and place: the audit of each segment."""
    paths = None
    for begins, row in _by_conversation(batches, pa.RecordBatch.to_pylist):
        if begins:
            if paths:
                yield _batch(paths.chosen(), _CHOSEN)
            paths = _Paths()
        paths.add(row["part"], row["number"], row["states"])
    if paths:
        yield _batch(paths.chosen(), _CHOSEN)


class _Total:
    """Counts and the hash of one conversation, segment after segment."""

    def __init__(self, conv_id):
        self.row = {"conv_id": conv_id, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0}
        self.audits: list[str] = []
        self.hash = hashlib.sha256()
        self.lines = self.distinct = 0
        self.first = self.last = self.initial = None

    def add(self, row: dict) -> None:
        for name in ("blank", "duplicate", "truncated", "illegal", "cost"):
            self.row[name] += row[name]
        if row["first_initial"] is not None:
            if self.initial is not None:
                self.row["illegal"] += _illegal(np.array([self.initial]), np.array([row["first_initial"]]))
            self.initial = row["last_initial"]
        if row["first_turn"] is not None:
            self.distinct += row["distinct_turns"] - (row["first_turn"] == self.last)
            self.first = row["first_turn"] if self.first is None else self.first
            self.last = row["last_turn"]
        self.audits.append(row["audit"])
        for role, text in written(row["audit"], row["entry"], row["roles"], row["texts"], row["copies"]):
            self.hash.update(f"{chr(10) * (self.lines > 0)}{role}:{text}".encode())
            self.lines += 1

    def result(self) -> pa.RecordBatch:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return _batch([self.row | {"gaps": gaps, "audit": "".join(self.audits),
                                   "repaired_sha256": self.hash.hexdigest()}], _RESULT)


def _finish(batches):
    """Rows sorted by conversation and place, with their audits: one result a conversation."""
    total = None
    for begins, row in _by_conversation(batches, pa.RecordBatch.to_pylist):
        if begins:
            if total:
                yield total.result()
            total = _Total(row["conv_id"])
        total.add(row)
    if total:
        yield total.result()


def _turns(batches):
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            turns = written(row["audit"], row["entry"], row["roles"], row["texts"], row["copies"])
            rows += [{"conv_id": row["conv_id"], "part": row["part"], "number": row["number"], "line": line,
                      "role": role, "text": text} for line, (role, text) in enumerate(turns)]
        yield _batch(rows, _TURN)


def _spark_schema(schema: pa.Schema):
    from pyspark.sql.pandas.types import from_arrow_schema
    return from_arrow_schema(schema)


class Repairs:
    """Repaired conversations: ``summary()`` has one row for each, ``turns()`` the repaired turns."""

    def __init__(self, segments: DataFrame):
        self.segments = segments
        places = ("conv_id", "part", "number")
        parts = segments.where("audit is null")
        chosen = (parts.select(*places, "states").repartition("conv_id").sortWithinPartitions(*places)
                  .mapInArrow(_choose, _spark_schema(_CHOSEN)))
        self.parts = parts.drop("states", "cost", "audit", "repaired_sha256").join(chosen, ["part", "number"])

    def summary(self) -> DataFrame:
        """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``."""
        gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("distinct_turns"), F.lit(0))
        whole = self.segments.where("audit is not null").select(
            "conv_id", gaps.alias("gaps"), *_RESULT.names[2:])
        pieced = (self.parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
                  .mapInArrow(_finish, _spark_schema(_RESULT)))
        return whole.unionByName(pieced)

    def turns(self) -> DataFrame:
        """``(conv_id, part, number, line, role, text)``; the middle three give the order inside a conversation."""
        lines = F.posexplode(F.arrays_zip("roles", "texts")).alias("line", "turn")
        whole = self.segments.where("audit is not null").select("conv_id", "part", "number", lines)
        return (whole.select("conv_id", "part", "number", "line", "turn.roles", "turn.texts").toDF(*_TURN.names)
                .unionByName(self.parts.mapInArrow(_turns, _spark_schema(_TURN))))


def repair(rows: DataFrame, segment: int = SEGMENT) -> Repairs:
    """Repair ``(conv_id, turn, role, text, copies)``; a conversation whose rows all have no copies is empty.

    Rows of a conversation go by turn, nulls first, and inside one turn by role and text. Null conversation
    ids are one conversation. A role counts by its first letter; one that is none of s, u and a can't be kept.
    """
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    placed = with_faults(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    return Repairs(stage(placed.mapInArrow(_Segments(segment), _spark_schema(_SEGMENT)), "turn-segments").df)
