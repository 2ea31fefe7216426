"""Lines by byte ranges next to the lines of whole files."""

from __future__ import annotations

import io
import os
import random

import pytest

from ratingloom.sources import text_ranges
from ratingloom.sources.coo_text import CooText
from ratingloom.sources.text_ranges import lines_between


class Opened(io.BytesIO):
    def read_at(self, count, offset):
        return self.getvalue()[offset: offset + count]


@pytest.mark.parametrize("chunk", [1, 3, 1000])
@pytest.mark.parametrize("size", [1, 2, 5, 17, 1000])
def test_every_line_in_one_range(monkeypatch, chunk, size):
    monkeypatch.setattr(text_ranges, "CHUNK_BYTES", chunk)
    rng = random.Random(size)
    for _ in range(30):
        data = "".join(rng.choice(["a", "bb", "\n", "\r\n", "\n\n", "0 1 2"]) for _ in range(rng.randrange(30))).encode()
        whole = [line for line in data.replace(b"\r", b"\n").split(b"\n") if line]
        found = [line for start in range(0, len(data), size)
                 for lines in lines_between(Opened(data), start, min(len(data), start + size)) for line in lines if line]
        assert found == whole, (data, size)


def test_header_longer_than_a_range(spark, tmp_path):
    comment = "% " + "x" * 500
    lines = [comment, "4" + " " * 300 + "5 6", "0 1 3.5", comment, "", "1\t2\t4", "3 4 1.0", "2 0 2", "0 0 5", "1 1 1", "9 9 9"]
    path = tmp_path / "r.txt"
    path.write_text("\n".join(lines))
    text = CooText(spark, str(path), range_bytes=40)
    assert text.header().collect()[0][1:] == (4, 5, 6)
    assert [tuple(r) for r in sorted(text.records().collect())] == [
        (0, 0, 1, 3.5), (1, 1, 2, 4.0), (2, 3, 4, 1.0), (3, 2, 0, 2.0), (4, 0, 0, 5.0), (5, 1, 1, 1.0)]
    assert text.surplus().first().num_surplus == 1
    plain = CooText(spark, [str(path)])
    assert sorted(plain.records().collect()) == sorted(text.records().collect())


def test_lines_are_not_written(spark, tmp_path):
    path = tmp_path / "r.txt"
    path.write_text("2 2 2\n0 0 1\n1 1 2\n")
    staged = f"{spark.conf.get('spark.checkpoint.dir')}/ratingloom"
    before = set(os.listdir(staged)) if os.path.isdir(staged) else set()
    assert CooText(spark, str(path)).records().count() == 2
    assert not any(name.startswith("text-lines") for name in set(os.listdir(staged)) - before)
