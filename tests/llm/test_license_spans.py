"""Wrapped headers, and suppression by containment next to a plain version."""

from __future__ import annotations

import random
import time

import pytest

from ratingloom.llm.license_rules import Detector, SignatureRule, default_rules

DETECTOR = Detector(default_rules())


def labels(text):
    return {DETECTOR.rules[n].label for _, _, n in DETECTOR.detections(text)}


@pytest.mark.parametrize("text, label", [
    ("licensed under the apache license,\n   version 2.0", "apache-2.0"),
    (" * licensed under the apache\n * license, version 2.0 (the license)", "apache-2.0"),
    ("# under the terms of the gnu general\n# public license version 3", "gpl-3.0"),
    ("the mit  license", "mit"), ("the mit\n// license", "mit"),
    ("placed in the public domain", "public-domain"), ("dedicated to the public domain", "public-domain"),
    ("released into the\npublic domain", "public-domain"), ("copyright (c) 2020", "copyright"), ("copyright\n  1999", "copyright")])
def test_wrapped_headers(text, label):
    assert label in labels(text)


def test_long_white_space_takes_little_time():
    started = time.perf_counter()
    labels("copyright" + " " * 300_000 + "apache license," + "\n" * 300_000 + "general")
    assert time.perf_counter() - started < 5


def plain(detector, text):
    found = [(rule.priority, m.end() - m.start(), -m.start(), -n, m.end()) for n, rule in enumerate(detector.rules)
             if any(word in text for word in rule.keyword.split("|")) for m in detector.patterns[n].finditer(text) if m.end() > m.start()]
    taken = []
    for _, _, start, number, end in sorted(found, reverse=True):
        if not any(a <= -start and end <= b for a, b, _ in taken):
            taken.append((-start, end, -number))
    return sorted(taken)


def test_suppression_equals_plain_one():
    rng = random.Random(4)
    rules = tuple(SignatureRule(f"r{k}", w[0], w, rng.randrange(4) * 10, 1.0)
                  for k, w in enumerate(["ab", "abc", "bc", "bca", "ca", "a[abc]{3}", "b.{2}", "c{2}", "ab[abc]*?c"]))
    detector = Detector(rules)
    for _ in range(400):
        text = "".join(rng.choice("abc ") for _ in range(rng.randrange(40)))
        assert detector.detections(text) == plain(detector, text)


def test_many_notices_take_linear_time():
    text = "all rights reserved. copyright 2001 the mit license. " * 20_000
    started = time.perf_counter()
    assert len(DETECTOR.detections(text)) == 60_000
    assert time.perf_counter() - started < 15
