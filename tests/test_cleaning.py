import pytest
from pyspark.sql import functions as F

from gristmill.operators import columns as C, formula as X, nulls as N, rows as R, transforms as T


def values(df, name, order="id"):
    return [r[name] for r in df.orderBy(order).collect()]


@pytest.mark.parametrize(
    "column, op, value, count",
    [("age", "gt", 26, 4), ("age", "notnull", None, 5), ("city", "eq", "NYC", 3), ("age", "isnull", None, 1),
     ("name", "ne", "Bob", 5), ("name", "contains", "li", 2), ("name", "not_contains", "li", 4), ("a", "contains", ".0", 6)],
)
def test_filter_rows(base, column, op, value, count):
    assert R.filter_rows(base, column, op, value).count() == count


def test_filter_rejects_bad_requests(base):
    with pytest.raises(ValueError):
        R.filter_rows(base, "name", "gt", 3)
    with pytest.raises(ValueError):
        R.filter_rows(base, "nope", "eq", 3)
    with pytest.raises(ValueError):
        R.filter_rows(base, "age", "like", 3)
    with pytest.raises(ValueError):
        R.filter_rows(base, "age", "eq")


def test_dedup_modes(base):
    twice = base.unionByName(base.filter("id = 1"))
    assert R.drop_duplicates(twice).count() == 6
    assert R.drop_duplicates(twice, "drop_all").count() == 5
    first = R.drop_duplicates(base, "subset_keep", "city", "first", "id")
    assert sorted(values(first, "id")) == [1, 2, 4]
    last = R.drop_duplicates(base, "subset_keep", "city", "last", "id")
    assert sorted(values(last, "id")) == [4, 5, 6]
    assert last.columns == base.columns
    nulls = base.sparkSession.createDataFrame([(None, 1), (None, 1)], "a string, b int")
    assert R.drop_duplicates(nulls).count() == 1
    with pytest.raises(ValueError):
        R.drop_duplicates(base, "subset_keep")


def test_fill_nulls(base):
    filled = N.fill_nulls(base, "constant", "name", "X")
    assert filled.metrics.first()["cells_filled"] == 1
    assert values(filled.df, "name")[5] == "X"
    mean = N.fill_nulls(base, "mean", ["age", "name"])
    assert values(mean.df, "age")[3] == 37.0
    assert {r["column"]: r["skipped"] for r in mean.metrics.collect()} == {"age": False, "name": True}
    assert values(N.fill_nulls(base, "median", "age").df, "age")[3] == 35.0
    assert values(N.fill_nulls(base, "mode", "name").df, "name")[5] == "Alice"
    forward = N.fill_nulls(base, "ffill", ["age", "name"], order_by="id")
    assert values(forward.df, "age")[3] == 35.0 and values(forward.df, "name")[5] == "Eve"
    backward = N.fill_nulls(base, "bfill", ["age", "name"], order_by="id")
    assert values(backward.df, "age")[3] == 45.0 and values(backward.df, "name")[5] is None
    assert {r["column"]: r["cells_filled"] for r in backward.metrics.collect()} == {"age": 1, "name": 0}
    with pytest.raises(ValueError):
        N.fill_nulls(base, "ffill", "age")
    with pytest.raises(ValueError):
        N.fill_nulls(base, "constant", "age", "word")


def test_integer_columns_are_filled_half_even(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id int, v long")
    assert values(N.fill_nulls(df, "mean", "v").df, "v")[2] == 2
    df = spark.createDataFrame([(1, 2), (2, 3), (3, None)], "id int, v long")
    assert values(N.fill_nulls(df, "median", "v").df, "v")[2] == 2


def test_all_null_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, None)], "id int, n double, s string")
    for strategy in ("mean", "median", "mode"):
        out = N.fill_nulls(df, strategy, ["n"])
        assert out.df.filter("n is not null").count() == 0
        assert out.metrics.first()["skipped"]
    empty = df.limit(0)
    assert N.fill_nulls(empty, "median", ["n"]).df.count() == 0
    assert N.drop_null_columns(empty, 10).columns == df.columns
    assert N.drop_null_columns(df, 50).columns == ["id"]


def test_drop_nulls(base):
    assert N.drop_nulls(base).count() == 4
    assert N.drop_nulls(base, "all", ["age", "name"]).count() == 6
    assert N.drop_nulls(base, "any", "name").count() == 5


def test_numeric_cast_guards(spark):
    words = [" 5 ", "5d", "1e3", "inf", "1_000", "$3", "", "ten", None, ".5", "-2."]
    df = spark.createDataFrame(list(enumerate(words)), "id int, c string")
    got = values(C.cast(df, {"c": "numeric"}), "c")
    assert got == [5.0, None, 1000.0, float("inf"), None, None, None, None, None, 0.5, -2.0]


def test_string_cast_prints_like_a_data_frame(spark):
    numbers = [1.0, 10000000.0, 0.0001, 1e16, 1e-5, 0.0, -2.5, 123456789.125, None, float("inf"), 1.5e20]
    df = spark.createDataFrame(list(enumerate(numbers)), "id int, c double")
    got = values(C.cast(df, {"c": "string"}), "c")
    expected = ["nan" if x is None else repr(x) for x in numbers]
    assert got == expected
    assert values(C.cast(df, {"c": "string"}, keep_null=True), "c")[8] is None


def test_boolean_cast_is_truthiness(spark):
    df = spark.createDataFrame([(0, "False"), (1, "0"), (2, ""), (3, None)], "id int, c string")
    assert values(C.cast(df, {"c": "boolean"}), "c") == [True, True, False, False]
    assert values(C.cast(df, {"c": "boolean"}, parse=True), "c")[0] is False
    numbers = spark.createDataFrame([(0, 0.0), (1, 2.0), (2, None)], "id int, c double")
    assert values(C.cast(numbers, {"c": "boolean"}), "c") == [False, True, True]


def test_datetime_cast_takes_the_format_of_the_first_value(spark):
    df = spark.createDataFrame(
        [(0, None), (1, "2023-01-02"), (2, "21-03-2023"), (3, "Invalid"), (4, "2023-13-45")], "id int, c string"
    )
    got = values(C.cast(df, {"c": "datetime"}, order_by="id"), "c")
    assert [str(x)[:10] if x else None for x in got] == [None, "2023-01-02", None, None, None]
    both = values(C.cast(df, {"c": "datetime"}, formats=["yyyy-MM-dd", "dd-MM-yyyy"]), "c")
    assert str(both[2])[:10] == "2023-03-21"
    with pytest.raises(ValueError):
        C.cast(df, {"c": "datetime"})


def test_integer_cast(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.5)], "id int, c double")
    assert values(C.cast(df, {"c": "integer"}, truncate=True), "c") == [1, 2]
    with pytest.raises(Exception, match="fractions"):
        C.cast(df, {"c": "integer"}).collect()
    assert C.apply_stored_casts(df, {"c": "integer", "gone": "string"}).schema["c"].dataType.simpleString() == "double"
    with pytest.raises(ValueError):
        C.cast_columns(df, {"c": "integer"})
    with pytest.raises(ValueError):
        C.cast_columns(df, {"c": "integer"}, force=True)
    _, applied, errors = C.cast_columns(df, {"c": "integer", "id": "float"}, force=True)
    assert applied == {"id": "float"} and "c" in errors


def test_category_cast_keeps_its_logical_type(base):
    cast = C.cast(base, {"city": "category"})
    assert cast.schema["city"].metadata == {"logical": "category"}


def test_column_names(spark):
    df = spark.createDataFrame([("x", 1)], ["First Name", "Age"])
    renamed, casts = C.normalize_column_names(df, {"First Name": "string"})
    assert renamed.columns == ["first_name", "age"] and casts == {"first_name": "string"}
    with pytest.raises(ValueError, match="both become"):
        C.normalize_column_names(spark.createDataFrame([(1, 2)], ["a b", "A-B"]))
    assert C.normalize_columns(spark.createDataFrame([(1,)], [" Total  Price($) "])).columns == ["total_price($)"]
    out, casts = C.rename_column(df, "Age", "Years", {"Age": "float"})
    assert out.columns == ["First Name", "Years"] and casts == {"Years": "float"}
    for old, new in (("Age", "Age"), ("Age", "First Name"), ("Nope", "x"), ("Age", " ")):
        with pytest.raises(ValueError):
            C.rename_column(df, old, new)
    out, casts = C.drop_columns(df, "Age", {"Age": "float", "First Name": "string"})
    assert out.columns == ["First Name"] and casts == {"First Name": "string"}


def test_add_column(base):
    assert values(C.add_column(base, "d", "divide", "a", "b"), "d") == [0.5] * 6
    zero = base.withColumn("z", F.lit(0.0))
    assert values(C.add_column(zero, "d", "divide", "a", "z"), "d") == [None] * 6
    for bad in (("a", "add", "a", "b"), ("n", "power", "a", "b"), ("n", "add", "name", "b")):
        with pytest.raises(ValueError):
            C.add_column(base, *bad)


def test_cell_updates(base, spark):
    assert values(C.update_cell(base, {"id": 2}, "name", "Zed"), "name")[1] == "Zed"
    assert values(C.update_cell(base, {"id": 2}, "age", None), "age")[1] is None
    with pytest.raises(ValueError):
        C.update_cell(base, {"id": 2}, "age", "old")
    patches = spark.createDataFrame([(1, "One"), (3, None)], "id long, name string")
    assert values(C.update_cells(base, patches, "id", "name"), "name")[:4] == ["One", "Bob", None, "Dave"]


def test_replace_values(base):
    out = C.replace_values(base, {"NYC": "New York", "LA": None}, ["city"])
    assert values(out.df, "city") == ["New York", None, "New York", "Chicago", None, "New York"]
    assert out.metrics.first()["cells_replaced"] == 5
    with pytest.raises(ValueError):
        C.replace_values(base, {"NYC": "x"})
    assert values(C.replace_values(base, {"25.0": "1"}, confirm_global=True).df, "age")[0] == 25.0
    assert values(C.replace_values(base, {25.0: 1}, ["age"]).df, "age")[0] == 1.0


def test_formulas(base, spark):
    assert X.fix_formula(base, "c", "add", "a", "b").metrics.first()["cells_fixed"] == 0
    holes = spark.createDataFrame([(1, 1.0, 2.0, None), (2, 2.0, 4.0, 6.0), (3, 3.0, 6.0, None)], "id int, a double, b double, c double")
    filled = X.fill_derived(holes, "c", "add", "a", "b")
    assert filled.metrics.first()["cells_filled"] == 2 and values(filled.df, "c") == [3.0, 6.0, 9.0]
    wrong = base.withColumn("c", F.when(F.col("id") == 2, 99.0).otherwise(F.col("c")))
    report = X.validate_formula(wrong, "c", "add", "a", "b").first()
    assert (report["checked_rows"], report["error_count"], report["error_pct"]) == (6, 1, 16.7)
    sample = X.formula_error_sample(wrong, "c", "add", "a", "b", "id").collect()
    assert [(r["id"], r["calculated"], r["difference"]) for r in sample] == [(2, 6.0, 93.0)]
    assert values(X.fix_formula(wrong, "c", "add", "a", "b").df, "c")[1] == 6.0
    with pytest.raises(ValueError):
        X.validate_formula(base, "c", "add", "a", "b", 0)


def test_text_cleaning(spark):
    words = ["o'neil mc-donald 3rd ÉTÉ", "\t padded\n", "", None, " x "]
    df = spark.createDataFrame(list(enumerate(words)), "id int, c string")
    for name in ("strip", "title", "lower", "upper"):
        got = values(T.clean_strings(df, "c", name).df, "c")
        assert got == [getattr(w, name)() if w is not None else None for w in words]
    assert T.clean_strings(df, "c", "strip").metrics.first()["cells_changed"] == 2


def test_datetime_parts(spark):
    df = spark.createDataFrame([(1, "2021-01-15"), (2, "2022-06-30"), (3, "2023-12-01")], "id int, date string")
    out = T.extract_datetime(df, "date", ["year", "month", "weekday"], order_by="id")
    assert [tuple(r)[2:] for r in out.orderBy("id").collect()] == [(2021, 1, 4), (2022, 6, 3), (2023, 12, 4)]
    with pytest.raises(ValueError):
        T.extract_datetime(df.withColumn("date_year", F.lit(1)), "date", ["year"], order_by="id")


def test_encodings(spark, base):
    encoded, mapping = T.encode_label(base, ["city", "name"], "id")
    assert values(encoded, "city") == [0, 1, 0, 2, 1, 0]
    assert values(encoded, "name") == [0, 1, 2, 3, 4, -1]
    assert mapping.filter("column = 'city'").count() == 3
    onehot = T.encode_onehot(base, "city")
    assert onehot.columns[-3:] == ["city_Chicago", "city_LA", "city_NYC"]
    assert values(onehot, "city_NYC") == [1, 0, 1, 0, 0, 1]
    wide = spark.range(60).selectExpr("id", "concat('val_', id) AS high_card")
    with pytest.raises(ValueError):
        T.encode_onehot(wide, "high_card")
    with pytest.raises(ValueError):
        T.encode_label(base, "age", "id")


def test_transforms_and_scaling(spark):
    df = spark.createDataFrame([(1, -1.0, 4.0, 5.0), (2, 8.0, 9.0, 5.0), (3, None, None, 5.0)], "id int, x double, y double, k double")
    log = T.transform_columns(df, ["x", "y"], "log")
    assert values(log.df, "x") == [-1.0, 8.0, None]
    assert {r["column"]: r["skipped"] for r in log.metrics.collect()} == {"x": True, "y": False}
    assert values(T.transform_columns(df, ["y"], "sqrt").df, "y") == [2.0, 3.0, None]
    assert values(T.transform_columns(df, ["x"], "cbrt").df, "x") == [-1.0, 2.0, None]
    scaled = T.scale_columns(df, ["x", "k"], "minmax")
    assert values(scaled.df, "x") == [0.0, 1.0, None] and values(scaled.df, "k") == [5.0] * 3
    assert {r["column"]: r["skipped"] for r in scaled.metrics.collect()} == {"x": False, "k": True}
    z = values(T.scale_columns(df, "x", "zscore").df, "x")
    assert z[0] == pytest.approx(-0.70710678) and z[2] is None


def test_a_number_written_as_text_equals_no_number(spark):
    df = spark.createDataFrame([(1, 1, 1.0, True, "1"), (2, 2, 2.0, False, "2")], "id long, i int, d double, b boolean, t string")
    df = df.withColumn("day", F.to_date(F.lit("2024-01-05")))
    for column, value in (("i", "1"), ("d", "1"), ("d", "1.0"), ("b", "true"), ("b", "1")):
        assert R.filter_rows(df, column, "eq", value).count() == 0
        assert R.filter_rows(df, column, "ne", value).count() == 2
    assert R.filter_rows(df, "t", "eq", "1").count() == 1 and R.filter_rows(df, "t", "eq", 1).count() == 0
    assert R.filter_rows(df, "day", "eq", "2024-01-05").count() == 2 and R.filter_rows(df, "day", "eq", "soon").count() == 0
