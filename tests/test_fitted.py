import datetime

import pytest

from gristmill import streaming as S
from gristmill.operators import columns as C, fitted as FT, formula as X, nulls as N, outliers as O, transforms as T

SCHEMA = "id long, name string, city string, age double, score long, a double, b double, c double, day timestamp, text string"


@pytest.fixture
def table(spark):
    rows = []
    for i in range(60):
        name = None if i % 11 == 0 else [" Ann ", "BOB", "eve x"][i % 3]
        age = None if i % 7 == 0 else float(20 + i % 13 + (500 if i == 33 else 0))
        score = None if i % 9 == 0 else (i * 7) % 23 + (900 if i == 12 else 0)
        c = None if i % 5 == 0 else (i + 2.0 + (1 if i % 8 == 0 else 0))
        rows.append((i, name, ["NYC", "LA", None, "Rome"][i % 4], age, score, float(i), 2.0, c, datetime.datetime(2024, 1 + i % 12, 1 + i % 28, i % 24), f"2024-0{1 + i % 9}-1{i % 10}"))
    return spark.createDataFrame(rows, SCHEMA)


FITS = {
    "fill mean": (lambda df: FT.fit_fill(df, "mean", ["age", "score"]), lambda df: N.fill_nulls(df, "mean", ["age", "score"]).df),
    "fill median": (lambda df: FT.fit_fill(df, "median", ["age", "score"]), lambda df: N.fill_nulls(df, "median", ["age", "score"]).df),
    "fill mode": (lambda df: FT.fit_fill(df, "mode", ["age", "score", "city", "day"]), lambda df: N.fill_nulls(df, "mode", ["age", "score", "city", "day"]).df),
    "fill constant": (lambda df: FT.fit_fill(df, "constant", ["city"], "x"), lambda df: N.fill_nulls(df, "constant", ["city"], value="x").df),
    "minmax": (lambda df: FT.fit_scale(df, ["age", "b"], "minmax"), lambda df: T.scale_columns(df, ["age", "b"], "minmax").df),
    "zscore": (lambda df: FT.fit_scale(df, ["age", "score"], "zscore"), lambda df: T.scale_columns(df, ["age", "score"], "zscore").df),
    "log": (lambda df: FT.fit_transform(df, ["age", "a"], "log"), lambda df: T.transform_columns(df, ["age", "a"], "log").df),
    "sqrt": (lambda df: FT.fit_transform(df, ["age", "a"], "sqrt"), lambda df: T.transform_columns(df, ["age", "a"], "sqrt").df),
    "cbrt": (lambda df: FT.fit_transform(df, ["score"], "cbrt"), lambda df: T.transform_columns(df, ["score"], "cbrt").df),
    "trim iqr": (lambda df: FT.fit_bounds(df, ["age", "score"]), lambda df: O.trim_outliers(df, ["age", "score"])),
    "trim zscore": (lambda df: FT.fit_bounds(df, ["age", "b"], "zscore", 3.0), lambda df: O.trim_outliers(df, ["age", "b"], "zscore", 3.0)),
    "impute mean": (lambda df: FT.fit_bounds(df, ["age", "score"], impute="mean"), lambda df: O.impute_outliers(df, ["age", "score"], "mean").df),
    "impute median": (lambda df: FT.fit_bounds(df, ["age", "score"], impute="median"), lambda df: O.impute_outliers(df, ["age", "score"], "median").df),
    "impute mode": (lambda df: FT.fit_bounds(df, ["age", "score"], impute="mode"), lambda df: O.impute_outliers(df, ["age", "score"], "mode").df),
    "cap": (lambda df: FT.fit_cap(df, ["age", "score"]), lambda df: O.cap_outliers(df, ["age", "score"]).df),
    "onehot": (lambda df: FT.fit_onehot(df, ["city"]), lambda df: T.encode_onehot(df, ["city"])),
    "label": (lambda df: FT.LabelCodes.fit(df, ["name", "city"], ["id"]), lambda df: T.encode_label(df, ["name", "city"], ["id"])[0]),
}
PLAIN = {
    "fill_constant": (lambda df: S.fill_constant(df, 5.0, ["age"]), lambda df: N.fill_nulls(df, "constant", ["age"], value=5.0).df),
    "replace_values": (lambda df: S.replace_values(df, {"LA": "L.A."}, ["city"]), lambda df: C.replace_values(df, {"LA": "L.A."}, ["city"]).df),
    "strip": (lambda df: S.clean_strings(df, ["name"], "strip"), lambda df: T.clean_strings(df, ["name"], "strip").df),
    "lower": (lambda df: S.clean_strings(df, ["name"], "lower"), lambda df: T.clean_strings(df, ["name"], "lower").df),
    "title": (lambda df: S.clean_strings(df, ["name"], "title"), lambda df: T.clean_strings(df, ["name"], "title").df),
    "fill_derived": (lambda df: S.fill_derived(df, "c", "add", "a", "b"), lambda df: X.fill_derived(df, "c", "add", "a", "b").df),
    "fix_formula": (lambda df: S.fix_formula(df, "c", "add", "a", "b"), lambda df: X.fix_formula(df, "c", "add", "a", "b").df),
    "extract_datetime": (lambda df: S.extract_datetime(df, "day", ["year", "weekday"]), lambda df: T.extract_datetime(df, "day", ["year", "weekday"])),
    "add_column": (lambda df: S.add_column(df, "s", "multiply", "a", "b"), lambda df: C.add_column(df, "s", "multiply", "a", "b")),
    "drop_nulls": (lambda df: S.drop_nulls(df, "any", ["age"]), lambda df: N.drop_nulls(df, "any", ["age"])),
}


def same(left, right):
    assert left.columns == right.columns
    near = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
    return sorted(map(near, left.collect()), key=repr) == sorted(map(near, right.collect()), key=repr)


@pytest.mark.parametrize("name", FITS)
def test_applied_to_its_own_table_it_equals_the_operator(table, name):
    fit, operator = FITS[name]
    step = fit(table)
    if isinstance(step, FT.Fitted):
        step = FT.Fitted.from_json(step.to_json())
    assert same(step.apply(table), operator(table))


def test_all_on_one_stream_each_equal_to_batch(spark, table, tmp_path):
    """Every operator runs on a stream until what is available is read, and equals its batch result."""
    table.write.parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    calls = {n: (lambda df, s=fit(stored): S.apply_fitted(df, s), operator) for n, (fit, operator) in FITS.items()} | PLAIN
    started = {}
    for i, (name, (on_stream, operator)) in enumerate(calls.items()):
        stream = spark.readStream.schema(stored.schema).parquet(str(tmp_path / "in"))
        out = on_stream(stream)
        assert out.isStreaming
        query = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"cp{i}")).trigger(availableNow=True).start(str(tmp_path / f"out{i}"))
        started[name] = (query, operator, out.schema, str(tmp_path / f"out{i}"))
    for name, (query, operator, schema, path) in started.items():
        assert query.awaitTermination(120), name
        assert same(spark.read.schema(schema).parquet(path), operator(stored)), name
    assert len(started) >= 25


def test_statistics_of_one_table_treat_another(spark, table, tmp_path):
    first, second = table.where("id < 30"), table.where("id >= 30")
    steps = [FT.fit_fill(first, "mean", ["age"]), FT.fit_cap(first, ["age"]), FT.fit_scale(first, ["age"], "minmax")]
    FT.save(spark, steps, str(tmp_path / "steps"))
    again = FT.load(spark, str(tmp_path / "steps"))
    assert again == steps
    low, high = steps[1].columns["age"]["low"], steps[1].columns["age"]["high"]
    base, width, mean = steps[2].columns["age"]["base"], steps[2].columns["age"]["width"], steps[0].columns["age"]["number"]
    want = {r["id"]: (min(max(mean if r["age"] is None else r["age"], low), high) - base) / width for r in second.collect()}
    got = {r["id"]: r["age"] for r in FT.apply_all(second, again).collect()}
    assert got == pytest.approx(want)


def test_new_labels_and_values(spark, table, tmp_path):
    codes = FT.LabelCodes.fit(table, ["city"], ["id"])
    codes.save(str(tmp_path / "codes"))
    new = spark.createDataFrame([(1, "Oslo"), (2, None), (3, "NYC"), (4, "LA")], "id long, city string")
    assert {r["id"]: r["city"] for r in FT.LabelCodes.load(spark, str(tmp_path / "codes")).apply(new).collect()} == {1: -1, 2: -1, 3: 0, 4: 1}
    hot = FT.fit_onehot(table, ["city"]).apply(new)
    assert hot.columns == ["id", "city_LA", "city_NYC", "city_Rome"] and {tuple(r) for r in hot.collect()} == {(1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 1, 0), (4, 1, 0, 0)}
    assert FT.fit_transform(table, ["b"], "log").apply(spark.createDataFrame([(-1.0,), (1.0,)], "b double")).collect() == [(None,), (0.0,)]


def test_wrong_requests(table):
    for call in (
        lambda: FT.fit_fill(table, "ffill"), lambda: FT.fit_fill(table, "constant"), lambda: FT.fit_scale(table, ["name"], "minmax"),
        lambda: FT.fit_cap(table, ["age"], 50, 10), lambda: FT.LabelCodes.fit(table, ["city"], []), lambda: FT.fit_onehot(table, ["city"], limit=2),
        lambda: FT.Fitted.from_json('{"operator": "x", "options": {}, "columns": {}}'), lambda: FT.fit_scale(table, ["age"], "zscore").apply(table.drop("age")),
    ):
        with pytest.raises(ValueError):
            call()
