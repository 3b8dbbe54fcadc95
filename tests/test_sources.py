import os

import pytest
from pyspark.sql import functions as F, types as T

from gristmill import streaming as S
from gristmill.operators import nulls as N, rows as R
from gristmill.sources import datasets as D, files

CSV = 'id,name,amount,flag,none\n1,"Ann, ""A""",1.5,True,\n2,n/a,NA,False,\n3,"two\nlines",-,True,nan\n'


def test_csv_types_and_missing_tokens(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(CSV)
    df = files.load(spark, str(path))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    assert kinds == {"id": "bigint", "name": "string", "amount": "string", "flag": "boolean", "none": "double"}
    rows = df.orderBy("id").collect()
    assert rows[0]["name"] == 'Ann, "A"' and rows[1]["name"] is None and rows[2]["name"] == "two\nlines"
    assert rows[2]["amount"] == "-"
    schema = T.StructType().add("id", "string").add("name", "string").add("amount", "double").add("flag", "string").add("none", "string")
    assert [r["amount"] for r in files.load(spark, str(path), schema=schema).orderBy("id").collect()] == [1.5, None, None]


def test_json_arrays_and_lines(spark, tmp_path):
    array, lines = tmp_path / "a.json", tmp_path / "b.json"
    array.write_text('[\n {"a": 1, "b": null},\n {"a": 2, "b": "x"}]')
    lines.write_text('{"a": 1, "b": null}\n{"a": 2, "b": "x"}\n')
    assert sorted(map(tuple, files.load(spark, str(array)).collect())) == sorted(
        map(tuple, files.load(spark, str(lines)).collect())
    )


def test_nan_becomes_null_and_casts_are_applied(spark, tmp_path):
    path = str(tmp_path / "n.parquet")
    files.save(spark.createDataFrame([(1, float("nan"), "7"), (2, 2.0, "x")], "id long, v double, t string"), path)
    df = files.load(spark, path, casts={"t": "integer"}, row_order=True)
    assert df.filter("v IS NULL").count() == 1
    assert [r["t"] for r in df.orderBy(files.ROW_FILE, files.ROW_NUMBER).select("id", "t").orderBy("id").collect()] == [7, None]


def test_unknown_formats(spark, base, tmp_path):
    for call in (lambda: files.load(spark, "x.xlsx"), lambda: files.save(base, "x.txt"), lambda: files.export(base, str(tmp_path), "xml")):
        with pytest.raises(ValueError):
            call()


def test_file_validation(spark, tmp_path):
    (tmp_path / "good.csv").write_text("a\n1\n")
    (tmp_path / "fake.parquet").write_text("nope")
    (tmp_path / "fake.xlsx").write_bytes(b"PK\x03\x04rest")
    (tmp_path / "odd.txt").write_text("x")
    (tmp_path / "big.json").write_text("x" * 5000)
    rows = {os.path.basename(r["path"]): r for r in files.validate_files(spark, str(tmp_path), 4000).collect()}
    assert {n: r["ok"] for n, r in rows.items()} == {
        "good.csv": True, "fake.parquet": False, "fake.xlsx": True, "odd.txt": False, "big.json": False,
    }
    assert rows["big.json"]["reason"] == "file is larger than the limit"


def test_versions_undo_and_revert(spark, base, tmp_path):
    data = D.Dataset.create(spark, str(tmp_path), "people", base)
    assert data.commit(R.filter_rows(base, "age", "notnull"), "FILTER_ROWS") == 1
    unchanged = N.fill_nulls(data.read(), "constant", "city", "x")
    assert data.commit(unchanged, "FILL_NULLS", counter="cells_filled") is None
    filled = N.fill_nulls(data.read(), "constant", "name", "x")
    assert data.commit(filled, "FILL_NULLS", counter="cells_filled") == 2
    assert data.head()["details"]["cells_filled"] == "1"
    assert data.undo() == 3 and data.read().filter("name IS NULL").count() == 1
    assert data.undo() == 4 and data.read().count() == 6
    with pytest.raises(ValueError, match="nothing to undo"):
        data.undo()
    assert data.revert(2) == 5 and data.read().filter("name = 'x'").count() == 1
    with pytest.raises(ValueError):
        data.revert(77)
    copy = data.duplicate()
    assert copy.name == "people_copy" and copy.head()["parent"] == "people" and copy.read().count() == 5
    log = D.activity_log(data.manifest(), "people", limit=2).collect()
    assert [r["version"] for r in log] == [5, 4]
    with pytest.raises(ValueError):
        D.activity_log(data.manifest(), limit=101)


def test_stored_casts_travel_with_versions(spark, tmp_path):
    df = spark.createDataFrame([("1", "x"), ("2", "y")], "n string, t string")
    data = D.Dataset.create(spark, str(tmp_path), "d", df, casts={"n": "integer"})
    assert data.read().schema["n"].dataType.simpleString() == "bigint"
    data.commit(data.read(), "CAST", casts={})
    data.undo()
    assert data.head()["casts"] == {"n": "integer"}


def test_row_operators_on_a_stream(spark, base, tmp_path):
    base.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(base.schema).parquet(str(tmp_path / "in"))
    kept = S.filter_rows(S.drop_nulls(stream, "any", "name"), "age", "gte", 30)
    kept = S.cast(S.add_column(kept, "sum", "add", "a", "b"), {"id": "string"})
    query = (
        kept.writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    query.processAllAvailable()
    query.stop()
    assert sorted((r["id"], r["sum"]) for r in spark.table("kept").collect()) == [("2", 6.0), ("3", 9.0), ("5", 15.0)]
