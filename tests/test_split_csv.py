"""CSV files read by ranges give the rows of the multi-line reader, whatever the ranges cut through."""

import random

import pytest

from storeline.sources import csv_tables, split_csv


def written(folder, name, text):
    path = folder / name
    path.write_bytes(text.encode())
    return str(path)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def awkward(n, seed, end="\n"):
    rng = random.Random(seed)
    cells = ["plain", "", '"quoted"', '"a, b"', f'"two{end}lines"', f'"say ""hi""{end}{end}{end}and, more"', '5" pipe', "é☃", f'"{"long " * 30}{end}x"', '""', '"end"""']
    lines = ["ID,Some Name,third"] + [",".join([str(i), rng.choice(cells), rng.choice(cells)]) for i in range(n)]
    return end.join(lines) + end


@pytest.mark.parametrize("size", [97, 1000, 30_000])
def test_equals_the_multi_line_reader(spark, tmp_path, size):
    path = written(tmp_path, "t.csv", awkward(400, size))
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        want = rows_of(whole)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert split_csv._lines(spark, path).rdd.getNumPartitions() >= min(30_000 // size, 8) or size == 30_000
        assert rows_of(split_csv.read_split(spark, path, whole.columns)) == want
        # the loader takes the same way, as the file is larger than a split
        assert rows_of(csv_tables.read_csv(spark, path)) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_folder_of_files_and_line_ends(spark, tmp_path):
    (tmp_path / "t.csv").mkdir()
    for k in range(3):
        written(tmp_path / "t.csv", f"part-{k}.csv", awkward(50, k, "\r\n" if k == 1 else "\n"))
    path = str(tmp_path / "t.csv")
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    got = [tuple(None if c is None else c.replace("\r\n", "\n") for c in r) for r in rows_of(split_csv.read_split(spark, path, whole.columns))]
    assert sorted(got, key=repr) == sorted((tuple(None if c is None else c.replace("\r\n", "\n") for c in r) for r in rows_of(whole)), key=repr)


def test_several_tasks_read_one_file(spark, tmp_path):
    path = written(tmp_path, "big.csv", awkward(20_000, 5))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = csv_tables.read_csv(spark, path)
        assert df.rdd.getNumPartitions() > 4 and df.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_empty_and_header_only(spark, tmp_path):
    for name, text in (("none.csv", ""), ("head.csv", "a,b\n")):
        path = written(tmp_path, name, text)
        assert split_csv.records(spark, path).where("not first").count() == 0


@pytest.mark.parametrize("line, inside, want", [
    ("a,b", False, False), ('a,"b', False, True), ('a,"b"', False, False), ('a,"b""', False, True), ('5" x,b', False, False),
    ('x"', True, False), ('x', True, True), ('x"",y', True, True), ('x","y', True, True), ('x",5" y,z', True, False), ("", True, True), ('"",""', False, False)])
def test_states(line, inside, want):
    assert split_csv.ends_inside(line, inside) is want
