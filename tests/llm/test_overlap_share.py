"""Overlaps that tolerate replaced words: no stretch with the share is lost to a longer one without it."""

from __future__ import annotations

import random

import numpy as np
import pytest

from ratingloom.llm.decontaminate import best_overlap, contaminated

ITEM = [f"q{k}" for k in range(90)]


def replaced(*parts):
    """The item with the words of every second part replaced."""
    places = np.repeat(np.arange(len(parts)), parts)
    return [word if n % 2 == 0 else f"x{k}" for k, (word, n) in enumerate(zip(ITEM, places))]


def test_good_stretches_around_a_bad_middle_are_found(spark):
    docs = {1: replaced(20, 18, 20), 2: replaced(12, 10, 12, 10, 12, 10, 12), 3: replaced(9, 10, 9), 4: ITEM}
    rows = contaminated(spark.createDataFrame([(i, "p p " + " ".join(t) + " p") for i, t in docs.items()], "doc_id long, text string"),
                        spark.createDataFrame([(7, " ".join(ITEM))], "item_id long, text string")).collect()
    found = {r.doc_id: (r.doc_word, r.item_word, r.n_words, r.n_equal) for r in rows}
    assert found == {1: (2, 0, 20, 20), 2: (2, 0, 34, 24), 4: (2, 0, 90, 90)}


@pytest.mark.parametrize("share", [0.5, 2 / 3, 0.7, 1.0])
def test_best_overlap_is_the_best_of_all_stretches(share):
    chance = random.Random(1)
    for _ in range(150):
        equal = np.array([chance.random() < 0.65 for _ in range(chance.randint(1, 40))])
        a, b = best_overlap(equal, share)
        stretches = [int(equal[i:j].sum()) for i in range(len(equal)) for j in range(i + 1, len(equal) + 1)
                     if equal[i:j].sum() >= share * (j - i)]
        assert equal[a:b].sum() == max(stretches, default=0) and equal[a:b].sum() >= share * (b - a)
