"""CSV in splits against a one-pass reader, at every split size down to a few bytes."""

import csv
import io
import random

import pytest

from kestrel.sources import csv_splits
from kestrel.sources.io import csv_scan, csv_sink

HARD = ["two\nlines", "", None, "  padded ", 'a "quoted" word', "back\\slash", 'comma, and "', "\r\nstart", "'", "\t", '"', '""', "\n", "\n\n\n", ',"\n,', "plain", "ünï\n中文", "x" * 40 + "\n" + "y" * 40]


def write(path, rows, end="\n"):
    """Quoted as the sink does: null unquoted and empty, the empty string quoted."""
    with open(path, "w", newline="", encoding="utf-8") as f:
        for row in rows:
            cells = ["" if c is None else '""' if c == "" else '"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n\r') else c for c in row]
            f.write(",".join(cells) + end)


def read(spark, path, size):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        return sorted((tuple(r) for r in csv_scan(spark, str(path), "id string, a string, b string").collect()), key=str)
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("size", [5, 17, 64, 1000, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_every_split_size(spark, tmp_path, size, end):
    r = random.Random(size)
    rows = [(str(i), r.choice(HARD), r.choice(HARD)) for i in range(40)]
    write(tmp_path / "a.csv", [("id", "first\nname", "b"), *rows[:20]], end)
    write(tmp_path / "b.csv", [("id", "first\nname", "b"), *rows[20:]], end)
    assert read(spark, tmp_path, size) == sorted(rows, key=str)


def test_stray_quotes_open_end_and_blank_lines(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,a,b\n\n1,in"side,5" disc\n2,"closed"tail,z\n\n3,"never closed\nand on')
    want = [("1", 'in"side', '5" disc'), ("3", "never closed\nand on", None)]
    for size in (6, 1000):
        got = read(spark, tmp_path, size)
        assert [g[0] for g in got] == ["1", "2", "3"]
        assert got[0] == want[0]


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    with open(tmp_path / "big.csv", "w") as f:
        f.write("id,a,b\n")
        for i in range(60_000):
            f.write(f'{i},"line one of {i}\nand ""two""",z\n' if i % 3 else f"{i},plain,\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(200_000))
    try:
        records = csv_splits.csv_records(spark, str(tmp_path))
        assert records.rdd.getNumPartitions() >= 8
        df = csv_scan(spark, str(tmp_path), "id int, a string, b string")
        assert df.count() == 60_000 and df.where("id % 3 = 0 and a = 'plain' and b is null").count() == 20_000
        assert df.where("id % 3 <> 0 and a = concat('line one of ', id, '\nand \"two\"') and b = 'z'").count() == 40_000
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("line,entry,end", [
    ("a,b", False, False), ("a,b", True, True), ('a,"b', False, True), ('a,"b', True, False), ('a"b', False, False), ('"', False, True), ('"', True, False),
    ('""', False, False), ('""', True, True), ('"a""', False, True), ('x"",y', True, True), ('x",y', True, False), ('x","y', True, True), ('x"y","z', True, True), ('x"y,"z"', True, False), ("", True, True),
])
def test_state_at_the_end_of_a_line(line, entry, end):
    assert csv_splits.ends_inside(line, entry) is end


def test_random_lines_against_a_state_machine():
    def machine(line, inside):
        state = "open" if inside else "start"
        for c in line:
            if state == "open":
                state = "closed" if c == '"' else "open"
            elif c == '"' and state in ("start", "closed"):
                state = "open"
            else:
                state = "start" if c == "," else "plain"
        return state == "open"

    r = random.Random(9)
    for _ in range(20_000):
        line = "".join(r.choice('",,a"') for _ in range(r.randrange(14)))
        for inside in (False, True):
            assert csv_splits.ends_inside(line, inside) is machine(line, inside), (line, inside)


def test_inferred_types(spark, tmp_path):
    df = spark.sql("select 1 as i, 3000000000 as l, 2.5D as d, date'2024-01-02' as day, true as t, 'x\ny' as s, cast(null as string) as n union all select 2, 4, 3D, date'2024-02-03', false, '', null")
    back = csv_scan(spark, csv_sink(df, str(tmp_path / "out")))
    assert [t for _, t in back.dtypes] == ["int", "bigint", "double", "date", "boolean", "string", "string"] and back.columns == df.columns
    assert sorted(back.collect()) == sorted(df.collect())


def test_missing_folder_and_empty_files(spark, tmp_path):
    (tmp_path / "only_header.csv").write_text("id,a,b\n")
    (tmp_path / "empty.csv").write_text("")
    assert csv_scan(spark, str(tmp_path), "id int, a string, b string").collect() == []
    with pytest.raises(Exception):
        csv_scan(spark, str(tmp_path / "none"), "id int").collect()
