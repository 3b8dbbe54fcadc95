import csv
import io
import random

import pandas as pd
import pytest

from gristmill.sources import files
from gristmill.sources.records import records


@pytest.fixture
def small_ranges(spark):
    """Files are cut into ranges of a few dozen bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def read(spark, path):
    df = files.load(spark, str(path), row_order=True)
    plan = df._jdf.queryExecution().toString()
    assert "multiLine=true" not in plan
    return [list(r)[:-2] for r in df.orderBy(files.ROW_FILE, files.ROW_NUMBER).collect()]


def test_a_break_at_the_border_of_two_ranges(spark, tmp_path, small_ranges):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n1,"x%s\n%sy"\n2,z\n' % ("p" * 30, "q" * 30))
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 1
    assert read(spark, path) == [[1, "x" + "p" * 30 + "\n" + "q" * 30 + "y"], [2, "z"]]


def test_a_record_over_many_ranges(spark, tmp_path, small_ranges):
    path = tmp_path / "t.csv"
    long = "\n".join(f'line {i} with ""quotes"" and, commas' for i in range(30))
    path.write_text(f'a,b\n1,"{long}"\n2,plain\n3,"again\n\n{long}"\n')
    whole = long.replace('""', '"')
    assert read(spark, path) == [[1, whole], [2, "plain"], [3, f"again\n\n{whole}"]]


def test_random_tables_as_pandas_reads_them(spark, tmp_path, small_ranges):
    draw = random.Random(11)
    for turn in range(3):
        rows = [[f"k{i}", *["".join(draw.choice('ab",\n é') for _ in range(draw.randint(1, 12))) for _ in range(2)]] for i in range(60)]
        text = io.StringIO()
        csv.writer(text, lineterminator="\n").writerows([["k", "x", "y"], *rows])
        path = tmp_path / f"{turn}.csv"
        path.write_text(text.getvalue())
        want = pd.read_csv(path, dtype=str).astype(object)
        want = want.where(want.notna(), None).values.tolist()
        assert read(spark, path) == want


def test_a_quote_inside_a_bare_field_is_a_character(spark, tmp_path, small_ranges):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n5" disk,x\n6" disk,"two\nlines"\nplain,7"\n')
    got = [(r.position, r.record) for r in records(spark, str(path)).orderBy("position").collect()]
    assert [r for _, r in got] == ["a,b", '5" disk,x', '6" disk,"two\nlines"', 'plain,7"']


def test_several_files_line_ends_and_empty_lines(spark, tmp_path, small_ranges):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    (folder / "1.csv").write_bytes(b'a,b\r\n1,"x\r\ny"\r\n\r\n2,z\r\n')
    (folder / "2.csv").write_bytes(b'a,b\n3,"' + b"w" * 90 + b'\n"\n4,v')
    assert read(spark, folder) == [[1, "x\r\ny"], [2, "z"], [3, "w" * 90 + "\n"], [4, "v"]]


def test_an_open_quote_is_an_error(spark, tmp_path, small_ranges):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n1,"x\n' + "2,y\n" * 40)
    with pytest.raises(ValueError, match="not closed"):
        files.load(spark, str(path))


def test_files_without_breaks_take_the_plain_reader(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n1,"x, ""y"""\n2,5" z\n')
    df = files.load(spark, str(path))
    assert "MapInArrow" not in df._jdf.queryExecution().toString()
    assert sorted(map(tuple, df.collect())) == [(1, 'x, "y"'), (2, '5" z')]
