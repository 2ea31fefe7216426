"""Windows of the line operator travel packed by bucket, and texts are cut by known places."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import functions as F

from ratingloom.llm import line_dedup, token_ids
from ratingloom.llm.line_dedup import WHOLE, LineRule, _line_windows, dedup_lines, lines_of
from ratingloom.llm.tables import trim
from ratingloom.llm.text_keys import utf8


def test_windows_travel_packed_and_a_common_one_once_a_task(spark):
    text = "\n".join(f"common line {k} of all" for k in range(20))
    docs = spark.createDataFrame([(k, f"{text}\nown {k} a\nown {k} b", 1000 + k) for k in range(300)],
                                 "doc_id long, text string, row long").coalesce(1)
    wanted = line_dedup._repeated_bitmap(docs.select("text"), LineRule(words=0))
    rows = line_dedup._entries(docs, LineRule(words=0), wanted).collect()
    windows = sum(len(r["keys"]) // 8 for r in rows if r["keys"] is not None)
    marks = sum(len(r["lines"]) // 8 for r in rows if r["keys"] is None and r["lines"] is not None)
    # 18 windows lie in all texts: the first of each is an entry, 18 * 299 others are known to go.
    assert windows == 18 and marks == 18 * 299
    wanted.destroy()


def test_cut_by_known_places_is_the_cut_by_lines(spark):
    chance = random.Random(11)
    gaps = [" ", "\n", " \t ", ".\n", " " * 254, " " * 255, "\n" * 256, " " * 1000]
    menu = ["é" * 3 + " über alles. ", "one\ntwo\nthree\n", "x" * 700 + "\n", "日本 語。 ok! "]
    rows = [(k if k % 7 else None, "".join(chance.choice(menu) + chance.choice(gaps) for _ in range(chance.randrange(9))))
            for k in range(200)] + [(1000, None), (1001, ""), (1002, " \n "), (5, "solo"), (5, "solo")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    keyed = table.select("doc_id", "text", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row")).collect()
    seen, want = set(), []
    for doc_id, text, _ in sorted(set(keyed), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.row)):
        lines = lines_of(pa.array([text or ""]))
        gone = set()
        keys, _, places = _line_windows(lines, LineRule(words=0))
        for key, place in sorted(zip(keys.tolist(), places.tolist()), key=lambda x: x[1]):
            if key in seen:
                gone |= set(range(place >> 32, place & 0xFFFFFFFF))
            seen.add(key)
        data = utf8(pa.array([text or ""]))[0].tobytes()
        edges = [*lines.starts.tolist(), len(data)]
        kept = data[: edges[0]] + b"".join(data[a:b] for k, (a, b) in enumerate(zip(edges, edges[1:])) if k not in gone)
        want += [(doc_id, None if text is None else kept.decode(), len(lines.keys), len(gone))] * rows.count((doc_id, text))
    got = [tuple(r) for r in dedup_lines(table, LineRule(words=0)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_places_of_lines_survive_packing():
    texts = pa.array(["a b\n\n" + "c " * 300 + ".", None, "", "  " * 400 + "x. y", "q" * 600 + "\nz"])
    for span in (0, WHOLE.span):
        lines = lines_of(texts, span)
        starts = line_dedup._starts(lines, utf8(texts)[1])
        runs = pa.array([b""] * len(texts), pa.binary())
        done = line_dedup._cut(texts, starts, runs)
        assert done.field("text").to_pylist() == [t or "" for t in texts.to_pylist()]
        assert done.field("n_lines").to_pylist() == (lines.firsts[1:] - lines.firsts[:-1]).tolist()


def test_tasks_of_other_operators_free_the_tokenizer():
    path = token_ids.tokenizer_path()
    coder = token_ids.encoder(path)
    ids = coder.encode(["one two three"], end=0)[0].tolist()
    coder.rest()
    assert token_ids._encoders[path] is coder
    trim()
    assert not token_ids._encoders
    assert token_ids.encoder(path).encode(["one two three"], end=0)[0].tolist() == ids
