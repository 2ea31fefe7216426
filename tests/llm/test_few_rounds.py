"""Rounds of the near-duplicate join, and components whose links are contracted within tasks first."""

from __future__ import annotations

from collections import Counter

import numpy as np

from ratingloom.llm import components as components_module
from ratingloom.llm import jaccard


def test_members_without_links_meet_in_few_rounds(spark, monkeypatch):
    """A passage in many prefixes links nothing; its members must not cost round after round."""
    names, made = Counter(), jaccard.stage

    def counting(df, name, *rest):
        names[name] += 1
        return made(df, name, *rest)

    monkeypatch.setattr(jaccard, "stage", counting)
    passage = " ".join(f"common{k}" for k in range(45))
    rows = [(n, " ".join(f"own{n}x{k}" for k in range(10)) + " " + passage) for n in range(400)]
    rows += [(1000 + n, f"{rows[7][1]} tail{n}") for n in range(3)]
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{n: n for n in range(400)}, 1000: 7, 1001: 7, 1002: 7}
    assert 1 < names["links"] <= 4


def test_contracted_links_keep_components(spark):
    chance = np.random.default_rng(3)
    a, b = chance.integers(-50, 150, 120), chance.integers(-50, 150, 120)
    chain = np.arange(200, 300)
    a, b = np.concatenate([a, chain[1:]]), np.concatenate([b, chain[:-1]])
    least = {int(n): int(n) for n in np.concatenate([a, b])}
    for _ in least:
        for x, y in zip(a.tolist(), b.tolist()):
            least[x] = least[y] = min(least[x], least[y])
    linked = {n: least[n] for x, y in zip(a.tolist(), b.tolist()) if x != y for n in (x, y)}
    hung = dict(zip(*(side.tolist() for side in components_module.contracted(a, b))))
    assert hung == {n: low for n, low in linked.items() if n != low}
    links = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a long, b long").repartition(7)
    found = [(r.node, r.component) for r in components_module.components(links).df.collect()]
    assert len(found) == len(linked) and dict(found) == linked
