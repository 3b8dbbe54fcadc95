"""URL filters: rules by host and path, and boosted trees on lexical features where no rule fits.

A rule names a host and the start of a path and allows or blocks what it fits: the host itself and
all its subdomains. The longest rule wins. URLs that a rule judges are the labelled ones: gradient
boosted trees learn from them what the other URLs look like, by length, depth, share of digits,
entropy, numbers of parameters and of host parts, and by suffix statistics, the smoothed share of
blocked URLs under the host's last part, its last two parts, and the last part together with the
first folder. A suffix with few labelled URLs borrows from the wider one. A labelled URL is left
out of its own statistics, so they tell a tree as much about it as about a new URL.

Everything is DataFrame and SQL functions and the trees of Spark's own library; no row passes
through Python. Suffix statistics are counted over all labelled URLs with partial aggregation and
joined by broadcast only if their written table is small. The trees are fitted on a sample of at
most about ``fit_rows`` labelled rows, chosen by a hash of the row.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is
judged by the trees; if all labelled URLs have one verdict, that is everyone's, and without any
labelled URL everything is allowed; repeated rows are judged alike; an empty table gives an empty
result; texts of any length are worked through whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from gristmill.llm.tables import small
from gristmill.plans.session import checkpoint

ALLOW, BLOCK = "allow", "block"
FIT_ROWS = 20_000
#: Weight of the wider suffix's share, in URLs.
PRIOR = 20.0
ROUNDS, DEPTH = 15, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        under = (host == self.host) | host.endswith("." + self.host)
        return under & path.startswith(self.path)


def rules(*written: str) -> list[Rule]:
    """Rules from ``allow com/`` or ``block example.com/en/``: the path starts at the first slash."""
    found = []
    for line in written:
        verdict, place = line.split(" ", 1)
        host, slash, path = place.partition("/")
        if verdict not in (ALLOW, BLOCK) or not slash or not host:
            raise ValueError(f"a rule reads 'allow host/path' or 'block host/path', not '{line}'")
        found.append(Rule(verdict, host, slash + path))
    return found


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where there is no ``://``."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    blank = F.lit("")
    return F.coalesce(F.translate(host, UPPER, LOWER), blank), F.coalesce(path, blank)


def ruled(host: Column, path: Column, listed: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null if none does."""
    text = verdict = None
    # Of two rules for one place the first one listed holds.
    for rule in sorted(listed, key=lambda r: -len(r.text)):
        fits = rule.fits(host, path)
        text = F.when(fits, rule.text) if text is None else text.when(fits, rule.text)
        verdict = F.when(fits, rule.verdict) if verdict is None else verdict.when(fits, rule.verdict)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if text is None else (text, verdict)


def share_of(text: Column, pattern: str) -> Column:
    """Share of the characters of ``text`` that match ``pattern``."""
    rest = F.length(F.regexp_replace(text, pattern, ""))
    return F.coalesce((F.length(text) - rest) / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))


def entropy(text: Column) -> Column:
    """Bits a character: from the lengths of the runs of equal characters once these are sorted."""
    ordered = F.array_join(F.sort_array(F.split(text, "")), "")
    runs = F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1*+"), F.lit(0))
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    total = F.aggregate(runs, F.lit(0.0), lambda sum_, run: sum_ + F.length(run) * F.log2(F.length(run).cast("double")))
    return F.log2(n) - total / n


LEXICAL = ("url_length", "host_length", "path_length", "host_parts", "longest_part", "depth", "digit_share", "host_digit_share", "sign_share", "bits", "parameters", "fragment", "secure")
SUFFIXES = ("last_part", "last_two", "section")
FEATURES = (*LEXICAL, *[f"{s}_{kind}" for s in SUFFIXES for kind in ("blocked", "seen")])


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    parts = F.split(host, r"\.")
    folders = F.filter(F.split(path, "/"), lambda f: f != "")
    asked = F.regexp_extract(url, r"\?([^#]*)", 1)
    found = {
        "url_length": F.length(url),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "host_parts": F.size(parts),
        "longest_part": F.array_max(F.transform(parts, F.length)),
        "depth": F.size(folders),
        "digit_share": share_of(url, "[0-9]+"),
        "host_digit_share": share_of(host, "[0-9]+"),
        "sign_share": share_of(url, "[0-9A-Za-z]+"),
        "bits": entropy(url),
        "parameters": F.size(F.filter(F.split(asked, "[&;]"), lambda p: p != "")),
        "fragment": url.contains("#").cast("int"),
        "secure": F.lower(F.substring(url, 1, 6)).startswith("https:").cast("int"),
    }
    return {name: F.coalesce(value.cast("double"), F.lit(0.0)) for name, value in found.items()}


def suffixes(host: Column, path: Column) -> dict[str, Column]:
    """Keys of the suffix statistics, from wide to narrow; each begins with its kind."""
    last = F.substring_index(host, ".", -1)
    folder = F.regexp_extract(path, "^/([^/]*)", 1)
    return {
        "last_part": F.concat(F.lit("1 "), last),
        "last_two": F.concat(F.lit("2 "), F.substring_index(host, ".", -2)),
        "section": F.concat(F.lit("3 "), last, F.lit("/"), folder),
    }


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """``key, seen, blocked`` over all labelled URLs, for every kind of suffix at once."""
    keys = F.explode(F.array(*[F.col(s) for s in SUFFIXES])).alias("key")
    return labelled.select(keys, "label").groupBy("key").agg(F.count("*").alias("seen"), F.sum("label").alias("blocked"))


def with_statistics(rows: DataFrame, counts: DataFrame, share: float) -> DataFrame:
    """Add each suffix's smoothed share of blocked URLs and the log of its count, the row itself left out.

    ``share`` is the share of blocked URLs among all labelled ones.
    """
    own = F.when(F.col("label").isNotNull(), 1).otherwise(0)
    wider = F.lit(float(share))
    for s in SUFFIXES:
        named = counts.select(F.col("key").alias(s), F.col("seen").alias(f"{s}_n"), F.col("blocked").alias(f"{s}_b"))
        rows = rows.join(named, s, "left")
        seen = F.coalesce(F.col(f"{s}_n"), F.lit(0)) - own
        blocked = F.coalesce(F.col(f"{s}_b"), F.lit(0)) - F.coalesce(F.col("label"), F.lit(0))
        above = wider if s != "section" else F.col("last_part_blocked")
        rows = rows.withColumn(f"{s}_blocked", (blocked + above * PRIOR) / (seen + PRIOR)).withColumn(f"{s}_seen", F.log1p(seen.cast("double")))
        wider = F.col(f"{s}_blocked")
    return rows


@dataclass
class UrlModel:
    """Suffix counts, the overall share of blocked URLs, and the trees; without trees, one verdict for all."""

    counts: DataFrame
    share: float
    trees: GBTClassificationModel | None
    only: str = ALLOW

    def judged(self, rows: DataFrame) -> DataFrame:
        """Add ``blocked``, the probability, and ``judgement`` to rows with features and suffixes."""
        if self.trees is None:
            share = F.lit(1.0 if self.only == BLOCK else 0.0)
            return rows.withColumn("blocked", share).withColumn("judgement", F.lit(self.only))
        from pyspark.ml.functions import vector_to_array

        ready = assembled(with_statistics(rows, self.counts, self.share))
        scored = self.trees.transform(ready).withColumn("blocked", vector_to_array("probability")[1])
        return scored.withColumn("judgement", F.when(F.col("prediction") == 1.0, BLOCK).otherwise(ALLOW))


def assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def url_rows(urls: DataFrame, id_column: str, url_column: str, listed: Sequence[Rule]) -> DataFrame:
    """Id, host, path, rule, label (1 blocked, 0 allowed, null without a rule), features and suffix keys."""
    plain = urls.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{url_column}`").cast("string"), F.lit("")).alias("url"))
    host, path = host_and_path(F.col("url"))
    cut = plain.withColumns({"host": host, "path": path})
    rule, verdict = ruled(F.col("host"), F.col("path"), listed)
    told = cut.withColumns({"rule": rule, "label": (verdict == BLOCK).cast("int")})
    return told.withColumns(lexical(F.col("url"), F.col("host"), F.col("path")) | suffixes(F.col("host"), F.col("path")))


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, seed: int = 42) -> UrlModel:
    """Learn from ``url_rows`` whose label is not null. Statistics use all of them, trees ``fit_rows``."""
    seen, blocked = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if blocked in (0, seen):
        return UrlModel(labelled.sparkSession.createDataFrame([], "key string, seen long, blocked long"), 0.0, None, BLOCK if blocked else ALLOW)
    counts, share = small(suffix_counts(labelled)), blocked / seen
    place = F.xxhash64("id", "url").cast("double") / F.lit(2.0**64) + F.lit(0.5)
    # Rows that are equal in id and URL share one place: they are counted once, with their number as weight.
    chosen = labelled.where(place < F.lit(fit_rows / seen)) if seen > fit_rows else labelled
    sample = with_statistics(chosen, counts, share).select("label", *FEATURES)
    sample = checkpoint(sample.groupBy("label", *FEATURES).agg(F.count("*").cast("double").alias("weight")).coalesce(1))
    boosting = GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, seed=seed, minInstancesPerNode=5, maxMemoryInMB=64
    )
    if sample.select("label").distinct().count() < 2:
        return UrlModel(counts, share, None, BLOCK if 2 * blocked > seen else ALLOW)
    return UrlModel(counts, share, boosting.fit(assembled(sample)))


def judge(urls: DataFrame, listed: Sequence[Rule], id_column: str = "page_id", url_column: str = "url", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Per row: the id, ``host, path, rule, verdict, blocked``; the verdict is the rule's, else the trees'."""
    rows = url_rows(urls, id_column, url_column, listed)
    model = fit(rows.where("label IS NOT NULL"), fit_rows)
    verdict = F.when(F.col("label") == 1, BLOCK).when(F.col("label") == 0, ALLOW).otherwise(F.col("judgement"))
    judged = model.judged(rows).select("id", "host", "path", "rule", verdict.alias("verdict"), "blocked")
    return judged.withColumnRenamed("id", id_column)


def allowed(urls: DataFrame, listed: Sequence[Rule], url_column: str = "url", fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``urls`` that are not blocked, with all their columns."""
    distinct = urls.select(F.col(f"`{url_column}`").alias("url")).distinct()
    blocked = judge(distinct, listed, "url", "url", fit_rows).where(F.col("verdict") == BLOCK).select(F.col("url").alias("blocked_url"))
    return urls.join(blocked, urls[url_column].eqNullSafe(blocked["blocked_url"]), "left_anti")
