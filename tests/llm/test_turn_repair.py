"""Conversation repair next to a plain search over the grammar's states."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ratingloom.llm import queries
from ratingloom.llm import turn_repair as tr

SF_DIR = "/root/testdata/sf0.1"
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}
SCHEMA = "conv_id long, turn long, role string, text string, cost string, part long"


def inserted(best):
    for _ in range(4):
        for state in list(best):
            for letter in FOLLOWS[state]:
                cost, audit = best[state]
                if letter != "s" and (letter not in best or (cost + 3, audit + "I") < best[letter]):
                    best[letter] = cost + 3, audit + "I"
    return best


def cheapest(rows):
    """``rows`` are (initial, must go, truncated); the least (cost, audit), state by state."""
    best = inserted({"": (0, "")})
    for initial, gone, cut in rows:
        ways = {}

        def offer(state, cost, audit):
            if state not in ways or (cost, audit) < ways[state]:
                ways[state] = cost, audit

        for state, (cost, audit) in best.items():
            offer(state, cost + 4, audit + "D")
            if not gone:
                for letter in FOLLOWS[state]:
                    if letter == initial:
                        offer(letter, cost + 3 * cut, audit + "K")
                    elif letter != "s":
                        offer(letter, cost + 3 + 3 * cut, audit + "R")
        best = inserted(ways)
    return min(best[end] for end in ("", "a") if end in best)


def plain(rows):
    """The contract on ``(conv_id, turn, role, text)``, one conversation after the other."""
    groups = {}
    for conv_id, turn, role, text in rows:
        after = groups.setdefault(conv_id, [])
        shown = [" " if value is None else str(value) for value in (conv_id, turn, role, text)]
        code = zlib.crc32(":".join(shown[:2]).encode()) % 20
        role, text = shown[2:]
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        after += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    results = {}
    for conv_id, after in groups.items():
        after.sort(key=lambda row: (row[0] is not None, row[0] or 0, row[1].encode(), row[2].encode()))
        counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        seen, given = set(), []
        for _, role, text in after:
            ends = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = ("blank" if not ends else "duplicate" if (role, text) in seen
                     else "truncated" if ends[-1] not in ".!?" else None)
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            given.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        pairs = [a[0] + b[0] for a, b in zip(given, given[1:])]
        turns = [turn for turn, _, _ in after if turn is not None]
        cost, audit = cheapest(given)
        lines, place, state = [], 0, ""
        for edit in audit:
            _, role, text = after[place] if edit != "I" else (None, "", "")
            place += edit != "I"
            if edit == "D":
                continue
            state = role[0] if edit == "K" else "a" if state == "u" else "u"
            role = role if edit == "K" else {"u": "user", "a": "assistant"}[state]
            lines.append(f"{role}:{text}")
        results[conv_id] = {
            "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **counts,
            "illegal": sum(pair not in ("su", "ua", "au") for pair in pairs), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}
    return results


def random_turns(rng, count):
    return [(rng.choice("suaauxua"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(count)]


def as_turns(rows):
    initials = np.array([tr._INITIALS.get(r[0], 4) for r in rows], np.int64)
    keep = np.array([tr._FAR if r[1] else 3 * r[2] for r in rows], np.int64)
    return tr.Turns(initials, keep, np.ones(len(rows), np.int64))


def test_alignment_equals_search():
    rng = random.Random(3)
    given = [random_turns(rng, rng.choice([0, 1, 2, 3, 5, 8, 13, 30])) for _ in range(400)]
    found = tr.align([as_turns(rows) for rows in given], [tr._WHOLE[0]] * 400, [tr._WHOLE[1]] * 400)
    assert [min(states.values()) for states in found] == [cheapest(rows) for rows in given]


@pytest.mark.parametrize("size", [1, 2, 5])
def test_segments_equal_whole(size):
    rng = random.Random(size)
    for _ in range(150):
        rows = random_turns(rng, rng.randrange(1, 25))
        paths = tr._Paths()
        for first in range(0, len(rows), size):
            states = tr.align([as_turns(rows[first: first + size])], [tr._ANY[0]], [tr._ANY[1]])[0]
            paths.add(0, first, [{"entry": e, "exit": x, "cost": c, "audit": a} for (e, x), (c, a) in states.items()])
        chosen = paths.chosen()
        assert (sum(c["cost"] for c in chosen), "".join(c["audit"] for c in chosen)) == cheapest(rows)


def awkward(rng):
    roles = ["system", "user", "assistant", "tool", "", None, "sys"]
    texts = ["Yes.", "No", "", "  \t", None, "Why? ", "a.b!", "x" * 5_000, "\u00e9\u3002", "Z."]
    rows = [(rng.choice([1, 2, 3, None, -4]), rng.choice([None, 0, 1, 2, 3, 3, 9, -2]), rng.choice(roles),
             rng.choice(texts)) for _ in range(300)]
    # One conversation with most rows, many of them alike, and single ones that damage drops.
    rows += [(7, k % 90, rng.choice(["user", "assistant"]), rng.choice(["Yes.", f"No {k}."])) for k in range(700)]
    return rows + [(conv, 0, "user", "Hm.") for conv in range(100, 160)] + [(7, 5, "user", "Same.")] * 400


def results(repairs):
    return {row.conv_id: {name: row[name] for name in tr._RESULT.names[1:]} for row in repairs.summary().collect()}


@pytest.mark.parametrize("segment", [3, 512])
def test_awkward_rows(spark, segment):
    rows = awkward(random.Random(11))
    table = spark.createDataFrame([(*row, "c", 5) for row in rows], SCHEMA).repartition(5)
    repairs = tr.repair(tr.damaged(table), segment)
    wanted = plain(rows)
    assert results(repairs) == wanted
    assert any(row["audit"] == "" for row in wanted.values())
    lines = {}
    for row in sorted(repairs.turns().collect(), key=lambda r: (r.part, r.number, r.line)):
        lines.setdefault(row.conv_id, []).append(f"{row.role}:{row.text}")
    for conv_id, row in wanted.items():
        text = "\n".join(lines.get(conv_id, []))
        assert hashlib.sha256(text.encode()).hexdigest() == row["repaired_sha256"]


def test_empty_table(spark):
    assert tr.repair(tr.damaged(spark.createDataFrame([], SCHEMA))).summary().count() == 0


def test_query(spark):
    found = queries.op13_turn_repair(spark, SF_DIR).collect()
    rows = [tuple(row) for row in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    wanted = plain(rows)
    assert len(found) == len(wanted)
    for row in found:
        assert {name: row[name] for name in tr._RESULT.names[1:]} == wanted[row.conv_id]
