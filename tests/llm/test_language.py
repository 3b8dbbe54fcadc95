import pytest

from gristmill.llm.language import accepted_documents, document_rows, fit, identify, page_rows, visible_text

EN = "the and of that with this was for not you are his they from have been which would there their "
FR = "le la les des une pour dans qui est avec sur pas mais nous vous ils été après très être où "


@pytest.fixture(scope="module")
def model(spark):
    rows = [(EN * 3, "en")] * 6 + [(FR * 3, "fr")] * 6 + [("x y z", "rare"), (None, "en"), ("a", None)]
    return fit(spark.createDataFrame(rows, "text string, lang string"))


def rows(spark, data):
    return spark.createDataFrame([(i, *r, "x") for i, r in enumerate(data)], "id long, text string, declared string, suffix string, domain string, host string, LANG2 string")


def judge(spark, model, data):
    return [r for r in sorted(identify(rows(spark, data), model).collect(), key=lambda r: r.id)]


def test_text_decides_and_hosts_help(spark, model):
    assert model.languages == ["en", "fr", "und"]
    data = [(EN, "en", None, None, "h1")] * 30 + [(FR, "fr", None, None, "h2")] * 30
    # A word that either language could have goes with its host and its declaration.
    data += [("mar", None, None, None, "h1"), ("mar", None, None, None, "h2"), ("mar", "en", None, None, None), ("mar", "fr", None, None, None)]
    data += [(FR, "en", None, None, "h1")]
    got = judge(spark, model, data)
    assert [r.lang for r in got[:60]] == ["en"] * 30 + ["fr"] * 30 and all(r.accepted for r in got[:60])
    assert [r.lang for r in got[60:64]] == ["en", "fr", "en", "fr"]
    assert got[64].lang == got[64].text_lang == "fr"


def test_suffix_and_domain_are_evidence(spark, model):
    data = [(FR, None, "fr", "a.fr", f"w{i}.a.fr") for i in range(20)] + [(EN, None, "uk", "b.uk", f"w{i}.b.uk") for i in range(20)]
    got = judge(spark, model, data + [("mar", None, "fr", None, None), ("mar", None, "uk", None, None), ("mar", None, None, "a.fr", "new.a.fr"), ("mar", None, None, "b.uk", None)])
    assert [r.lang for r in got[40:]] == ["fr", "en", "fr", "en"]


def test_odd_rows(spark, model):
    data = [(None, "en", None, None, "h"), ("", None, None, None, None), ("12 ## !!", "en", "uk", "b.uk", "h"), ("中文" * 30, None, None, None, None), (EN, None, None, None, None)]
    got = judge(spark, model, data + [data[0]])
    assert [r.lang for r in got] == ["und", "und", "und", "und", "en", "und"]
    assert [r.accepted for r in got] == [False, False, False, False, True, False]
    assert "LANG2" in got[0] and "text" not in got[0]
    assert identify(rows(spark, data).limit(0), model).collect() == []
    empty = fit(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang for r in judge(spark, empty, data)} == {"und"}


def test_pages(spark, model):
    page = f"<!DOCTYPE html><HTML class=x lang='fr-CA'><head><script>the and of</script><!-- the --></head><p>{FR}&eacute;</p>"
    data = [(1, "https://user@www.Example.co.fr:80/x?y=http://z.uk", page), (2, None, None), (3, "nonsense", "<p>the</p>"), (4, "http://localhost/", "")]
    got = {r.page_id: r for r in page_rows(spark.createDataFrame(data, "page_id long, url string, html string"), "page_id").collect()}
    assert (got[1].declared, got[1].suffix, got[1].domain, got[1].host) == ("fr", "fr", "co.fr", "www.example.co.fr")
    assert (got[2].declared, got[2].host, got[2].text) == (None, None, "") and got[3].host is None and got[4].suffix is None
    assert "script" not in got[1].text and "the" not in got[1].text.split() and "é" in got[1].text
    assert visible_text("a<br>b &amp; c") == "a b & c"


def test_accepted_documents_keep_their_rows(spark):
    data = [(i, EN + str(i), "en", "s", 1, "x") for i in range(8)] + [(8, None, "en", "s", 1, "x"), (8, EN, "en", "s", 1, "x"), (None, "... !", None, None, None, None), (9, EN, "en", "s", 2, "y"), (9, EN, "en", "s", 2, "y")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, LANG2 string")
    got = accepted_documents(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9]
    assert document_rows(df).count() == len(data)


def test_every_labelled_language_has_a_model(spark):
    rows = [(EN * 3, tag) for tag in ("en", "EN-us", "en_GB", " en ")] + [(FR * 3, "fr")] * 4
    rows += [("der die und das nicht mit auch sich " * 1000, "de"), (EN, "und"), (EN, ""), ("ja nej och att det som en på är av för ", "Swedish")]
    assert fit(spark.createDataFrame(rows, "text string, lang string")).languages == ["de", "en", "fr", "swedish", "und"]
    many = [(f"{chr(97 + i // 26)}{chr(97 + i % 26)}q " * 20, f"{chr(97 + i // 26)}{chr(97 + i % 26)}x") for i in range(210)]
    assert len(fit(spark.createDataFrame(many, "text string, lang string")).languages) == 211


def test_declared_languages_without_model_pass(spark, model):
    data = [("中文" * 30, "zh", None, None, None), ("中文" * 30, None, None, None, None), ("!!", "zh", None, None, None), ("中文" * 30, "und", None, None, None)]
    got = judge(spark, model, data)
    assert [(r.lang, r.accepted) for r in got] == [("zh", True), ("und", False), ("und", False), ("und", False)]
    assert got[0].confidence == 0.0


def test_the_sample_is_bounded_and_exact(spark):
    rows = [(f"{EN} {i % 700}", "en") for i in range(2000)]
    df = spark.createDataFrame(rows, "text string, lang string")
    chosen = sorted((r.h, r.text) for r in df.selectExpr("xxhash64(text) h", "text").collect())[:50]
    small, whole = fit(df, per_language=50), fit(spark.createDataFrame([(t, "en") for _, t in chosen], "text string, lang string"))
    assert (small.table == whole.table).all()
