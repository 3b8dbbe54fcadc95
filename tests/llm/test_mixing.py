import pytest

from gristmill.llm.mixing import mix, mixed_documents

DOCS = "doc_id long, text string, source string, n_chars long, TAKEN string"


def test_null_and_empty_rows(spark):
    rows = [(1, None, "a", 1, "x"), (2, "", "a", 0, "x"), (3, "one two", None, 7, "x"), (None, "u v w", "b", 5, "x"), (4, " ", None, 1, "x")]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in mix(df).collect()}
    assert [got[i].size for i in (1, 2, 3, None, 4)] == [0, 0, 2, 3, 0]
    assert got[1].taken == 0 and got[2].taken == 0
    # a weighs 1 and is empty, b weighs 2, null weighs 3: five words at 2 to 3.
    assert got[None].target == pytest.approx(2.0) and got[3].target == pytest.approx(3.0)
    assert got[None].taken == 2 and got[3].taken == 3
    copies = mixed_documents(df).collect()
    assert sorted((r.doc_id or 0, r.epoch, r.text, r.words) for r in copies) == [(0, 1, "u v", 2), (3, 1, "one two", None), (3, 2, "one", 1)]
    assert mix(df.limit(0)).collect() == [] and mixed_documents(df.limit(0)).collect() == []


def test_no_source_exceeds_its_cap(spark):
    rows = [(i, "w " * 100, "big", 0, "") for i in range(50)] + [(100 + i, "w " * 10, "small", 0, "") for i in range(5)]
    got = mix(spark.createDataFrame(rows, DOCS)).collect()
    small = [r for r in got if r.source == "small"]
    assert all(r.target == 150.0 and r.taken == 3 * r.size for r in small)
    assert sum(r.taken for r in got) == 5050 // 1


def test_equal_ids_share_the_cut(spark):
    rows = [(1, "a b c d", "s", 0, "")] * 4 + [(2, "e f", "t", 0, "")]
    got = mix(spark.createDataFrame(rows, DOCS)).collect()
    ones = [r.taken for r in got if r.doc_id == 1]
    assert len(set(ones)) == 1 and sum(ones) <= got[0].target + 4
    assert sorted(map(str, got)) == sorted(map(str, mix(spark.createDataFrame(rows[::-1], DOCS)).collect()))


def test_hot_source_spreads(spark, monkeypatch):
    from gristmill.llm import mixing

    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 10)
    rows = [(i, "w " * (i % 7 + 1), "hot" if i % 3 else f"s{i % 5}", 0, "") for i in range(500)]
    got = mix(spark.createDataFrame(rows, DOCS)).collect()
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert sum(r.taken for r in own) == int(own[0].target)
