"""Line deduplication by the rule of the query: every window of three lines counts."""

from __future__ import annotations

import os
import random

import pyarrow as pa
import pytest

import brute
import corpus_pipeline
from ratingloom.llm import queries
from ratingloom.llm.line_dedup import WHOLE, LineRule, _line_windows, dedup_lines, lines_of
from ratingloom.llm.text_keys import words

SF_DIR = "/root/testdata/sf0.001"
MENU = "Home\nAbout us\nContact\n"


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_short_windows_count(spark):
    docs = table(spark, [(1, MENU + "A page of its own."), (2, MENU + "Another page."), (3, "yes\n" * 50)])
    for got in (dedup_lines(docs, WHOLE), corpus_pipeline.drop_repeated_lines(spark, docs, SF_DIR)):
        kept = {r.doc_id: r.text for r in got.collect()}
        assert kept[1] == MENU + "A page of its own." and kept[2] == "Another page." and kept[3] == "yes\n"


def plain_pieces(text, span=8):
    """Pieces of the lines as ``(words, begins a line)``, cut after the least of any ``span`` words, the last of equals."""
    found = []
    for line in brute.lines(text):
        rank = [int(k) >> 32 for k in words(pa.array([" ".join(line)]), lower=False).keys]
        cuts = {min(range(k, k + span), key=lambda p: (rank[p], -p)) + 1 for k in range(len(line) - span + 1)}
        edges = sorted({0, len(line)} | cuts)
        found += [(line[a:b], a == 0) for a, b in zip(edges, edges[1:])]
    return found


def removed_pieces(rows):
    seen, result = set(), {}
    for i, text in sorted(rows):
        own, gone, runs = plain_pieces(text), set(), []
        begins = [k for k, (_, whole) in enumerate(own) if whole] + [len(own)]
        inside = [not whole for _, whole in own] + [False]
        for a, b in zip(begins, begins[3:]):
            runs.append((a, b, tuple(" ".join(w for p, _ in own[x:y] for w in p)
                                     for x, y in zip(begins, begins[1:]) if a <= x < b)))
        for a in range(len(own)):
            ends = [b for b in range(a + 3, len(own) + 1) if sum(len(p) for p, _ in own[a:b]) >= 10][:1]
            runs += [(a, b, " ".join(w for p, _ in own[a:b] for w in p)) for b in ends if any(inside[a: b + 1])]
        for a, b, run in sorted(runs, key=lambda r: r[:2]):
            if run in seen:
                gone |= set(range(a, b))
            seen.add(run)
        result[i] = (len(own), len(gone))
    return result


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the test tables")
def test_query_removes_what_plain_windows_cover(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    texts = [tuple(r) for r in docs.collect()]
    want = brute.removed_lines(texts, least_words=0)
    got = {r.doc_id: (r.n_lines, r.n_removed_lines) for r in dedup_lines(docs, LineRule(words=0)).collect()}
    assert got == want and want != brute.removed_lines(texts)
    got = {r.doc_id: (r.n_lines, r.n_removed_lines) for r in queries.op2_line_windows(spark, SF_DIR).collect()}
    assert got == removed_pieces(texts)


def test_passages_inside_sentences_are_found(spark):
    chance = random.Random(5)

    def some(count, tag):
        return [f"{tag}{chance.randrange(10 ** 6)}" for _ in range(count)]

    rows = []
    for n in range(40):
        # Every other passage holds the end of a sentence.
        passage = some(25, "p") + ["end." if n % 2 else "mid"] + some(24, "p")
        rows += [(2 * n, " ".join(some(chance.randrange(1, 30), "a") + passage + some(chance.randrange(1, 30), "b"))),
                 (2 * n + 1, " ".join(some(chance.randrange(1, 30), "c") + passage + some(chance.randrange(1, 30), "d")))]
    for got in (dedup_lines(table(spark, rows), WHOLE), corpus_pipeline.drop_repeated_lines(spark, table(spark, rows), SF_DIR)):
        kept = {r.doc_id: r.text for r in got.collect()}
        assert all(kept[i] == text for i, text in rows if i % 2 == 0)
        # Ten words of a passage at least are gone, and none of the words around it.
        for i, text in rows:
            if i % 2:
                lost = set(text.split()) - set(kept[i].split())
                assert len(lost) >= 10 and all(w[0] in "pem" for w in lost)


def test_any_run_of_47_words_holds_a_window():
    chance = random.Random(3)

    def some(count):
        return [f"v{chance.randrange(300)}" + chance.choice([""] * 9 + ["."]) for _ in range(count)]

    for _ in range(300):
        run = some(47)
        texts = [" ".join(some(chance.randrange(40)) + [tag] + run + [tag] + some(chance.randrange(40))) for tag in "xy"]
        keys, text, _ = _line_windows(lines_of(pa.array(texts), WHOLE.span), WHOLE)
        assert set(keys[text == 0]) & set(keys[text == 1])
