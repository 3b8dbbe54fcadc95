import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gristmill.llm import urlfilter
from gristmill.llm.queries import URL_RULES
from gristmill.llm.urlfilter import FEATURES, allowed, entropy, fit, judge, rules, suffixes, url_rows, with_statistics


def plain_rule(url, listed=URL_RULES):
    if url is None or "://" not in url:
        host = path = ""
    else:
        after = url.split("://", 1)[1]
        host = re.split("[/?#]", after, maxsplit=1)[0]
        path = re.split("[?#]", after[len(host) :], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for r in listed:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.text) > len(best.text)):
            best = r
    return host, path, best and best.text, best and best.verdict


URLS = [
    None, "", "no scheme", "://", "http://", "http:///only/path", "HTTP://WWW.Example.COM/en/1", "https://example.com/en/", "https://example.com/EN/", "https://example.com/en",
    "https://com/", "https://com", "https://xcom/a", "https://a.com", "https://a.com/", "https://notexample.com/en/x", "https://a.b.example.com/en/x?y=1#z", "http://www.example.com/en/x",
    "http://m.www.example.com/en/x", "https://x.net/es/1", "https://net/fr/1", "https://x.net/frx/1", "https://x.net/fr?q", "https://x.net?/fr/", "https://x.net#/fr/", "https://x.org/en/1",
    "https://user:pw@h.com:80/p", "a://b://c.com/", "https://É.COM/É?é#é", "https://ÀB.net/es/", "http://x.net//es/", "https://x.org/" + "a1" * 50_000 + "?b=" + "c&" * 5_000, "https://\U0001f600.org/ \n\t",
]


def test_rules_as_brute_force(spark):
    rows = list(enumerate(URLS)) + [(None, "https://x.net/es/1"), (None, "https://x.net/es/1"), (3, "https://x.org/twice")]
    got = judge(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect()
    found = Counter((r.page_id, r.host, r.path, r.rule) for r in got)
    assert found == Counter((i, *plain_rule(u)[:3]) for i, u in rows)
    by_rule = {(r.page_id, r.host, r.path): r.verdict for r in got if r.rule}
    assert all(by_rule[i, h, p] == v for i, u in rows for h, p, t, v in [plain_rule(u)] if t)
    assert all(r.verdict in ("allow", "block") for r in got)


def test_rules_are_read(spark):
    assert [(r.verdict, r.host, r.path) for r in rules("allow com/", "block example.com/en/")] == [("allow", "com", "/"), ("block", "example.com", "/en/")]
    for bad in ("deny com/", "allow com", "allow /x"):
        with pytest.raises(ValueError):
            rules(bad)


def test_entropy_and_lexical_features(spark):
    texts = ["", "aaaa", "abab", "https://x.org/abc?d=1&e=2;f#g", "é中é\U0001f600", "z" * 30_000 + "y" * 10_000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", entropy(F.col("t")).alias("e")).collect()
    for row in got:
        n = len(texts[row.i])
        want = -sum(c / n * math.log2(c / n) for c in Counter(texts[row.i]).values()) if n else 0.0
        assert row.e == pytest.approx(want, abs=1e-9)
    one = url_rows(spark.createDataFrame([(1, "https://a1.bcd.org/x/22/y.html?p=1&&q;r#s")], "page_id long, url string"), "page_id", "url", URL_RULES).first()
    assert (one.url_length, one.host_length, one.path_length, one.host_parts, one.longest_part, one.depth) == (41, 10, 12, 3, 3, 3)
    assert (one.parameters, one.fragment, one.secure) == (3, 1, 1) and one.digit_share == pytest.approx(4 / 41) and one.host_digit_share == pytest.approx(0.1)
    assert (one.last_part, one.last_two, one.section) == ("1 org", "2 bcd.org", "3 org/x")


def spread(n, seed=5):
    """URLs of two kinds: blocked ones have long digits and many parameters, of any host."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        bad = draw.random() < 0.4
        host = f"h{draw.randint(0, 40)}.site{draw.randint(0, 9)}.{draw.choice(['net', 'org'])}"
        path = "/".join([f"{draw.randint(10**8, 10**9)}" if bad else draw.choice(["news", "about", "story"]) for _ in range(2 + bad)])
        query = "&".join(f"k{j}={draw.randint(0, 99)}" for j in range(draw.randint(2, 5) if bad else draw.randint(0, 1)))
        rows.append((i, f"https://{host}/{path}?{query}", int(bad)))
    return rows


def test_trees_learn_lexical_features(spark):
    rows = spread(3_000)
    table = url_rows(spark.createDataFrame(rows, "page_id long, url string, bad int"), "page_id", "url", URL_RULES)
    labels = {i: bad for i, _, bad in rows}
    known = table.where("id < 2000").drop("label").join(spark.createDataFrame([(i, b) for i, b in labels.items()], "id long, label int"), "id")
    model = fit(known)
    new = model.judged(table.where("id >= 2000")).select("id", "judgement", "blocked").collect()
    assert len(new) == 1_000
    assert sum((r.judgement == "block") == bool(labels[r.id]) for r in new) >= 970
    assert all((r.blocked >= 0.5) == (r.judgement == "block") for r in new if r.blocked != 0.5)


def test_suffix_statistics_leave_the_row_out(spark):
    rows = [(i, f"https://a{i}.x.org/p/{i}") for i in range(6)] + [(9, "https://b.y.net/q/")]
    table = url_rows(spark.createDataFrame(rows, "page_id long, url string"), "page_id", "url", URL_RULES)
    told = table.drop("label").withColumn("label", F.when(F.col("id") < 4, (F.col("id") < 2).cast("int")).cast("int"))
    counts = urlfilter.suffix_counts(told.where("label IS NOT NULL"))
    got = {r.id: r for r in with_statistics(told, counts, 0.5).collect()}
    share = lambda b, n, above: (b + above * urlfilter.PRIOR) / (n + urlfilter.PRIOR)
    assert got[5].last_part_blocked == pytest.approx(share(2, 4, 0.5)) and got[5].last_part_seen == pytest.approx(math.log1p(4))
    assert got[0].last_part_blocked == pytest.approx(share(1, 3, 0.5)) and got[3].last_part_blocked == pytest.approx(share(2, 3, 0.5))
    assert got[5].last_two_blocked == pytest.approx(share(2, 4, share(2, 4, 0.5))) and got[5].section_blocked == pytest.approx(share(2, 4, share(2, 4, 0.5)))
    assert got[9].last_part_blocked == 0.5 and got[9].last_two_seen == 0.0


def test_one_verdict_or_none(spark):
    frame = lambda urls: spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert {r.verdict for r in judge(frame(["https://x.org/", "https://y.org/"]), URL_RULES).collect()} == {"allow"}
    assert {r.verdict for r in judge(frame(["https://x.org/", "https://y.net/es/"]), URL_RULES).collect()} == {"block"}
    assert judge(frame([]), URL_RULES).collect() == []
    assert {(r.rule, r.verdict) for r in judge(frame(["https://x.com/a", None]), []).collect()} == {(None, "allow")}


def test_columns_and_allowed_rows(spark):
    rows = [(i, u, "x", 1) for i, u, _ in spread(200)] + [(500, "https://a.com/x", "y", 2), (501, "https://x.net/es/1", "z", 3), (502, None, "n", 4), (502, None, "n", 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, HOST string, label int").withColumn("features", F.lit(0))
    got = judge(pages, URL_RULES)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "blocked"] and got.count() == len(rows)
    verdicts = {r.page_id: r.verdict for r in got.collect()}
    kept = allowed(pages, URL_RULES)
    assert kept.columns == pages.columns
    assert sorted(r.page_id for r in kept.collect()) == sorted(r[0] for r in rows if verdicts[r[0]] == "allow")
    assert set(FEATURES).isdisjoint({"label", "id"})


def test_given_pages_and_no_python_in_the_plan(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = judge(pages, URL_RULES)
    plan = got._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "NestedLoop" not in plan and "Cartesian" not in plan
    urls = {r.page_id: r.url for r in pages.collect()}
    for r in got.collect():
        host, path, rule, verdict = plain_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and (rule is None or r.verdict == verdict)


def test_held_out_labels_of_the_given_pages(spark):
    """Four fifths of the URLs that rules judge teach the trees the rest."""
    pages = spark.read.parquet("/root/testdata/check_s/pages.parquet")
    table = url_rows(pages, "page_id", "url", URL_RULES).where("label IS NOT NULL")
    out = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    model = fit(table.where(~out))
    held = table.where(out).withColumnRenamed("label", "truth").withColumn("label", F.lit(None).cast("int"))
    right, n, most = model.judged(held).agg(F.avg(((F.col("judgement") == "block") == (F.col("truth") == 1)).cast("int")), F.count("*"), F.avg("truth")).first()
    assert n > 500 and right > 0.9 and right > max(most, 1 - most)
    assert suffixes(F.col("host"), F.col("path")).keys() == {"last_part", "last_two", "section"}
