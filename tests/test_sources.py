from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ratingloom import RunConfig, read_ratings, read_run_config, read_run_configs, read_targets
from ratingloom.sources.coo_binary import read_coo_binary
from ratingloom.sources.factor_text import factor_lines, write_factor_text
from ratingloom.sources.run_config import unknown_keys

CONTENT = "% comment\n3 4 3\n0 1 3.5\n1\t2\t4\n% between\n  2   3 1 \n"


def rows(ratings):
    return [tuple(r) for r in ratings.orderBy("rec_id").select("rec_id", "user_id", "item_id", "rating").collect()]


def test_text_with_comments_and_tabs(spark, tmp_path):
    (tmp_path / "a.txt").write_text(CONTENT)
    loaded = read_ratings(spark, str(tmp_path / "a.txt"))
    assert rows(loaded.ratings) == [(0, 0, 1, 3.5), (1, 1, 2, 4.0), (2, 2, 3, 1.0)]
    assert tuple(loaded.dims.first()) == (3, 4, 3)
    assert loaded.require_valid() is loaded


def test_text_with_one_based_ids(spark, tmp_path):
    (tmp_path / "a.txt").write_text("2 2 2\n1 1 5\n2 2 1\n")
    assert rows(read_ratings(spark, str(tmp_path / "a.txt"), id_base=1).ratings) == [(0, 0, 0, 5.0), (1, 1, 1, 1.0)]


def test_lines_beyond_the_announced_number_are_ignored(spark, tmp_path):
    (tmp_path / "a.txt").write_text("2 2 1\n0 0 5\n1 1 1\nrest of the file\n")
    loaded = read_ratings(spark, str(tmp_path / "a.txt"))
    assert rows(loaded.ratings) == [(0, 0, 0, 5.0)]
    assert loaded.check().first().valid


def test_text_split_over_many_tasks_keeps_order(spark, tmp_path):
    records = [(n * 7 % 50, n * 3 % 40, float(n % 9)) for n in range(2000)]
    lines = ["% head", "50 40 2000"]
    for n, (u, i, r) in enumerate(records):
        lines += [f"% note {n}"] if n % 97 == 0 else []
        lines.append(f"{u} {i} {r}")
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        loaded = read_ratings(spark, str(tmp_path / "a.txt")).ratings
        assert spark.read.text(str(tmp_path / "a.txt")).rdd.getNumPartitions() > 5
        assert rows(loaded) == [(n, *r) for n, r in enumerate(records)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_folder_of_text_files(spark, tmp_path):
    folder = tmp_path / "set.txt"
    folder.mkdir()
    (folder / "part-0.txt").write_text("5 5 2\n0 0 1\n1 1 2\n")
    (folder / "part-1.txt").write_text("5 5 1\n4 4 3\n")
    loaded = read_ratings(spark, str(folder))
    assert rows(loaded.ratings) == [(0, 0, 0, 1.0), (1, 1, 1, 2.0), (2, 4, 4, 3.0)]
    assert tuple(loaded.dims.first()) == (5, 5, 3)
    (folder / "part-2.txt").write_text("6 5 0\n")
    with pytest.raises(Exception, match="disagree"):
        read_ratings(spark, str(folder)).dims.collect()


@pytest.mark.parametrize("content, flag", [
    ("2 2 3\n0 0 1\n1 1 1\n", "bad_missing_records"),
    ("2 2 2\n0 0 1\n2 1 1\n", "bad_large_users"),
    ("2 2 2\n0 0 1\n1 2 1\n", "bad_large_items"),
    ("2 2 2\n0 0 1\n-1 1 1\n", "bad_negative_users"),
    ("2 2 2\n0 0 1\n1 -4 1\n", "bad_negative_items"),
    ("2 2 2\n0 0 1\n1 1 many\n", "bad_null_ratings"),
    ("2 2 2\n0 0 1\n1 x 3\n", "bad_null_ids"),
    ("2 2 2\n0 0 1\n1\n", "bad_null_ids"),
])
def test_load_checks(spark, tmp_path, content, flag):
    (tmp_path / "a.txt").write_text(content)
    loaded = read_ratings(spark, str(tmp_path / "a.txt"))
    row = loaded.check().first()
    assert row[flag] == 1 and not row.valid
    with pytest.raises(ValueError, match=flag):
        loaded.require_valid()


def test_empty_set_is_valid(spark, tmp_path):
    (tmp_path / "a.txt").write_text("3 3 0\n")
    loaded = read_ratings(spark, str(tmp_path / "a.txt"))
    assert loaded.ratings.count() == 0 and loaded.check().first().valid


def write_binary(path, header, header_type, records):
    body = np.array(records, dtype="<u4,<u4,<f4")
    path.write_bytes(np.array([header], dtype=header_type).tobytes() + body.tobytes())


@pytest.mark.parametrize("layout, header_type, base", [("narrow", "<u4,<u4,<u4", 0), ("wide", "<u4,<u4,<u8", 1)])
def test_binary_layouts_split_by_ranges(spark, tmp_path, layout, header_type, base):
    records = [(n % 31 + base, n % 17 + base, n / 4) for n in range(1000)]
    write_binary(tmp_path / "a.bin", (31, 17, 1000), header_type, records)
    split = read_coo_binary(spark, str(tmp_path / "a.bin"), layout, range_bytes=1200)
    assert split.rdd.getNumPartitions() == 10
    assert rows(split) == [(n, u - base, i - base, r) for n, (u, i, r) in enumerate(records)]
    loaded = read_ratings(spark, str(tmp_path / "a.bin"), layout=layout)
    assert tuple(loaded.dims.first()) == (31, 17, 1000) and loaded.check().first().valid


def test_short_binary_file_is_reported(spark, tmp_path):
    write_binary(tmp_path / "a.bin", (5, 5, 4), "<u4,<u4,<u4", [(0, 0, 1.0), (1, 1, 2.0)])
    row = read_ratings(spark, str(tmp_path / "a.bin")).check().first()
    assert row.bad_missing_records == 2 and not row.valid


def test_folder_of_binary_files(spark, tmp_path):
    folder = tmp_path / "set.bin"
    folder.mkdir()
    write_binary(folder / "a.bin", (5, 5, 2), "<u4,<u4,<u4", [(0, 0, 1.0), (1, 1, 2.0)])
    write_binary(folder / "b.bin", (5, 5, 1), "<u4,<u4,<u4", [(4, 4, 3.0)])
    loaded = read_ratings(spark, f"file://{folder}")
    assert rows(loaded.ratings) == [(0, 0, 0, 1.0), (1, 1, 1, 2.0), (2, 4, 4, 3.0)]
    assert tuple(loaded.dims.first()) == (5, 5, 3)


def test_other_names_are_read_as_text_and_parquet_by_suffix(spark, tmp_path, make_ratings):
    (tmp_path / "a.data").write_text("1 1 1\n0 0 2\n")
    with pytest.warns(UserWarning, match="unrecognized"):
        assert rows(read_ratings(spark, str(tmp_path / "a.data")).ratings) == [(0, 0, 0, 2.0)]
    make_ratings([(0, 3, 1.0), (2, 0, 5.0)]).write.parquet(str(tmp_path / "r.parquet"))
    assert tuple(read_ratings(spark, str(tmp_path / "r.parquet")).dims.first()) == (3, 4, 2)


def test_run_configurations(spark, tmp_path):
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "a.in").write_text(
        "# first\n\ngd_mode               1\nlearning_rate 0.003\nlearning_rate 0.2\nlearning_rate 0.01\ncolour 3\n")
    (tmp_path / "runs" / "b.in").write_text("% second\nbatch_size\t16\n")
    table = {r.run: RunConfig.from_row(r) for r in read_run_configs(spark, str(tmp_path / "runs")).collect()}
    assert table == {"a.in": RunConfig(gd_mode=1, learning_rate=0.01), "b.in": RunConfig(batch_size=16)}
    assert [tuple(r) for r in unknown_keys(spark, str(tmp_path / "runs")).collect()] == [("a.in", "colour")]
    with pytest.warns(UserWarning, match="colour"):
        assert read_run_config(spark, str(tmp_path / "runs" / "a.in")).gd_mode == 1
    with pytest.warns(UserWarning, match="not found"):
        assert read_run_config(spark, str(tmp_path / "none.in")) == RunConfig()
    with pytest.raises(AnalysisException):
        read_run_configs(spark, str(tmp_path / "none.in"))


@pytest.mark.parametrize("wrong", [{"gd_mode": 3}, {"batch_size": 0}, {"precision": 9}, {"num_features": 0}])
def test_wrong_parameters_are_rejected(wrong):
    with pytest.raises(ValueError):
        RunConfig(**wrong)


def test_targets(spark, tmp_path):
    (tmp_path / "t.txt").write_text("films-small   0.831\nfilms          0.914\n")
    assert sorted(map(tuple, read_targets(spark, str(tmp_path / "t.txt")).collect())) == [
        ("films", 0.914), ("films-small", 0.831)]


def test_factor_text(spark, tmp_path):
    import datetime
    values = [(i, [i / 7, -i * 1.5e-5, 0.0]) for i in range(50)]
    table = spark.createDataFrame(values, "id int, features array<double>").repartition(5)
    path = write_factor_text(table, str(tmp_path), "user", datetime.datetime(2024, 3, 9, 8, 7, 6))
    assert path.endswith("user-02-09-08-07-06.txt")
    written = [r.value for r in spark.read.text(path, wholetext=False).select(
        "value", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n")).orderBy("f", "n").collect()]
    assert written == ["".join("%10.2g " % np.float32(x) for x in row) for _, row in values]
    assert factor_lines(table).count() == 50


def test_surplus_records_are_counted(spark, tmp_path):
    (tmp_path / "a.txt").write_text("2 2 2\n0 0 1\n1 1 2\n0 1 3\n% note\n1 0 4\n")
    loaded = read_ratings(spark, str(tmp_path / "a.txt"))
    assert loaded.ratings.count() == 2 and loaded.check().first().surplus_records == 2
    with pytest.warns(UserWarning, match="2 records beyond"):
        loaded.require_valid()


def test_text_does_not_depend_on_how_files_are_split(spark, tmp_path):
    lines = [f"{k % 50} {k % 70} {k % 5 + 1}" for k in range(20000)]
    (tmp_path / "big.txt").write_text("50 70 20000\n" + "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
        loaded = read_ratings(spark, str(tmp_path / "big.txt"))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "32768")
        rows = loaded.ratings.orderBy("rec_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.rec_id, r.user_id, r.item_id) for r in rows] == [(k, k % 50, k % 70) for k in range(20000)]


def test_ids_beyond_31_bits_are_counted(spark, tmp_path):
    (tmp_path / "a.txt").write_text("2 2 2\n0 0 1\n3000000000 1 2\n")
    row = read_ratings(spark, str(tmp_path / "a.txt")).check().first()
    assert row.bad_null_ids == 1 and not row.valid


def test_one_configuration_file_and_all_unknown_keys(spark, tmp_path):
    (tmp_path / "runs").mkdir()
    for name in ("a.in", "b.in"):
        (tmp_path / "runs" / name).write_text("num_features 3\n" + "".join(f"odd{k} 1\n" for k in range(20)))
    with pytest.raises(ValueError, match="several"):
        read_run_config(spark, str(tmp_path / "runs"))
    with pytest.warns(UserWarning, match="20 unrecognized"):
        assert read_run_config(spark, str(tmp_path / "runs" / "a.in")).num_features == 3


def test_record_ranges_outside_a_filter_are_not_opened(spark, tmp_path, make_ratings):
    from ratingloom import fixtures
    from ratingloom.operators import profiles
    from ratingloom.sources import coo_binary
    records = make_ratings([(n % 7, n % 5, float(n % 3)) for n in range(1000)])
    path = fixtures.write_coo_binary(records, profiles.dimensions(records).first(), str(tmp_path / "r.bin"), "narrow", 0, files=2)
    ranged = coo_binary.read_coo_binary(spark, path, range_bytes=600).where("rec_id >= 230 and rec_id < 270 and user_id <> 3")
    assert ranged.rdd.getNumPartitions() == 1
    assert sorted(r.rec_id for r in ranged.collect()) == [n for n in range(230, 270) if n % 7 != 3]
    assert [r.rec_id for r in coo_binary.read_coo_binary(spark, path).where("rec_id = 777").collect()] == [777]
    assert coo_binary.read_coo_binary(spark, path).where("rec_id > 5000").count() == 0
    reader = coo_binary.CooBinaryReader({"path": path, "layout": "narrow", "rangeBytes": "600"})
    whole = reader.partitions()
    list(reader.pushFilters([coo_binary.GreaterThan(("rec_id",), 699), coo_binary.LessThanOrEqual(("rec_id",), 720)]))
    assert len(whole) == 20 and sum(p.count for p in reader.partitions()) == 21
