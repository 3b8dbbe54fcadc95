"""Secret scans with multipart credential linking, on DataFrame functions only.

Strong kinds are reported wherever they stand: ``assign`` (a keyword and its value), ``access``
(an access key id) and ``hex`` (a long hexadecimal run). Weak kinds say little alone: ``ident``
(an account or client name), ``secret`` (a long run with capitals, small letters and digits) and
``endpoint`` (an address). A weak candidate is reported only if the parts that complete it
stand in its scope. Scopes follow the text: a scope is a block, which ends at an empty line, and
it reaches at least a fixed number of characters to either side, across blocks:

* a weak ``secret`` needs an ``access`` or ``ident``,
* an ``ident`` needs an ``assign``, ``hex`` or ``secret``,
* an ``endpoint`` needs both.

A weak candidate inside a strong part is that part and not another one; one that only overlaps
strong parts stays a candidate.

Scopes are joined as intervals: parts are cut into bins, the equality is on text and bin (on text
and block for the rest of a block), and the semi join returns each candidate at most once however
many parts complete it. Positions count code points, ends are exclusive. Time grows with the
length of a text, however many matches it has.

Defined cases: a null text is empty and has no parts; repeated rows are reported alike; a null
id is kept; an empty table gives an empty result; extra columns are passed over. Only rows
with a candidate are located; no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gristmill.llm.tables import free_name
from gristmill.plans.session import checkpoint

# Kinds in the order they are listed, with pattern, group measured and least length.
RANDOM = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("ident", r"""(?i:(user(?:name)?|login|client_?id|account))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)""", 2, 3),
    ("secret", RANDOM, 0, 20),
    ("endpoint", r"""(?i:https?)://[^\x20\x09-\x0D"'<>]+""", 0, 10),
]
STRONG = 3
SCOPE = 200
BIN = 1024
STRETCH = 512  # pieces that are cut from one stretch of a text
EMPTY_LINE = r"\n[\x20\t\r]*\n"
CHUNK = 64  # array elements that are walked again for each of them
SPAN = "struct<start:int,end:int>"


def empty(element: str) -> Column:
    return F.array().cast(f"array<{element}>")


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often and in whatever loop it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, join) -> Column:
    """What ``join`` (a sum or a maximum, from 0) makes of the values before each value.

    An accumulator that held an array would be copied at every step. So values are cut into
    chunks: the totals of the chunks before, and a value's own chunk up to the value.
    """
    total = lambda part: F.aggregate(part, F.lit(0), join)

    def inside(totals: Column):
        def chunk(part: Column, number: Column) -> Column:
            before = lambda base: F.transform(part, lambda _, j: join(base, total(F.slice(part, 1, j))))
            return once(total(F.slice(totals, 1, number)), before)

        return chunk

    def summed(parts: Column) -> Column:
        return once(F.transform(parts, total), lambda totals: F.flatten(F.transform(parts, inside(totals))))

    return once(chunked(values), summed)


def chunked(values: Column, size: int = CHUNK) -> Column:
    """``values`` in arrays of ``size``; one empty array if there are none."""

    def cut(every: Column) -> Column:
        last = F.floor((F.greatest(F.size(every), F.lit(1)) - 1) / F.lit(size)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(every, i * size + 1, F.lit(size)))

    return once(values, cut)


def located(text: Column, pattern: str, group: int, least: int) -> Column:
    """Spans ``(start, end)`` of the matches whose ``group`` has ``least`` characters or more.

    A pattern is matched leftmost and without overlaps; a match's place is the total length of
    the matches and of the pieces between them that come before it.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), measured.alias("value"))

    def span(piece: Column, before: Column) -> Column:
        start = before + F.length(piece["gap"])
        good = F.length(piece["value"]) >= least
        if pattern == RANDOM:
            good = good & piece["hit"].rlike("[A-Z]") & piece["hit"].rlike("[a-z]") & piece["hit"].rlike("[0-9]")
        return F.when(good, F.struct(start.alias("start"), (start + F.length(piece["hit"])).alias("end")).cast(SPAN))

    def placed(every: Column) -> Column:
        lengths = F.transform(every, lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["hit"]), F.lit(0)))
        return F.array_compact(F.zip_with(every, running(lengths, lambda a, b: a + b), span))

    return F.when(text.rlike(pattern), once(pieces, placed)).otherwise(empty(SPAN))


def scan(documents: DataFrame) -> DataFrame:
    """``doc_id``, a key of the row, and the spans of each kind; no text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kinds = {name: located(F.col("body"), pattern, group, least) for name, pattern, group, least in KINDS}
    rows = documents.select("doc_id", text.alias("body"))
    return rows.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("owner"),
        F.xxhash64("body").alias("print"),
        *[spans.alias(name) for name, spans in kinds.items()],
        located(F.col("body"), EMPTY_LINE, 0, 0).alias("breaks"),
    )


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then by the order of kinds, joined by commas."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    one = F.transform(
        F.array_sort(spans),
        lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(one, ",")


def ordered(name: str, number: int) -> Column:
    return F.transform(
        F.col(name), lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"))
    )


def blocked(scanned: DataFrame) -> DataFrame:
    """The parts of all texts, each once, with the number of the block they start in.

    A text without a weak candidate has nothing to link and is left out. Empty lines are rows
    among the parts, and a part's block is the number of empty lines before it.
    """
    weak = F.greatest(*[F.size(k[0]) for k in KINDS[STRONG:]]) > 0
    marks = F.concat(*[ordered(k[0], i) for i, k in enumerate(KINDS)], ordered("breaks", -1))
    rows = scanned.where(weak).dropDuplicates(["owner", "print"]).select("owner", "print", F.inline(marks))
    so_far = Window.partitionBy("owner", "print").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("block", F.sum((F.col("kind") < 0).cast("int")).over(so_far)).where("kind >= 0")


def linked(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak candidates completed in their scope: ``owner, print, weak`` (array of spans)."""
    parts = checkpoint(blocked(scanned))
    strong = parts.where(F.col("kind") < STRONG)
    weak = checkpoint(outside(parts.where(F.col("kind") >= STRONG), strong))
    every = strong.unionByName(weak)
    number = {k[0]: i for i, k in enumerate(KINDS)}
    names = every.where(F.col("kind").isin(number["access"], number["ident"]))
    keys = every.where(F.col("kind").isin(number["assign"], number["hex"], number["secret"]))
    secrets = completed(weak.where(F.col("kind") == number["secret"]), names, scope)
    idents = completed(weak.where(F.col("kind") == number["ident"]), keys, scope)
    endpoints = completed(completed(weak.where(F.col("kind") == number["endpoint"]), names, scope), keys, scope)
    shown = secrets.unionByName(idents).unionByName(endpoints)
    return shown.groupBy("owner", "print").agg(F.collect_list(F.struct("start", "kind", "end")).alias("weak"))


def binned(parts: DataFrame, reach: int) -> DataFrame:
    """One row for each bin that a part, widened by ``reach``, touches."""
    first = F.floor((F.col("start") - reach) / F.lit(BIN))
    last = F.floor((F.col("end") - 1 + reach) / F.lit(BIN))
    return parts.withColumn("bin", F.explode(F.sequence(first, last)))


def completed(parts: DataFrame, others: DataFrame, reach: int) -> DataFrame:
    """The parts that have one of ``others`` in their block or within ``reach`` characters."""
    key = ["owner", "print", "block"]
    inside = parts.join(others.select(key).distinct(), key, "left_semi")
    left = binned(parts, reach).alias("l")
    right = binned(others, 0).alias("r")
    touch = (
        (F.col("l.owner") == F.col("r.owner")) & (F.col("l.print") == F.col("r.print")) & (F.col("l.bin") == F.col("r.bin"))
        & (F.col("r.start") < F.col("l.end") + reach) & (F.col("l.start") < F.col("r.end") + reach)
    )
    close = left.join(right, touch, "left_semi").drop("bin")
    return inside.select(parts.columns).unionByName(close).distinct()


def outside(parts: DataFrame, others: DataFrame) -> DataFrame:
    """The parts that none of ``others`` holds whole: who holds a part holds its first bin too."""
    left = parts.withColumn("bin", F.floor(F.col("start") / F.lit(BIN))).alias("l")
    right = binned(others, 0).alias("r")
    holds = (
        (F.col("l.owner") == F.col("r.owner")) & (F.col("l.print") == F.col("r.print")) & (F.col("l.bin") == F.col("r.bin"))
        & (F.col("r.start") <= F.col("l.start")) & (F.col("l.end") <= F.col("r.end"))
    )
    return left.join(right, holds, "left_anti").drop("bin")


def secret_spans(documents: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row: ``doc_id``, counts of the strong kinds, ``base`` and ``spans`` as arrays."""
    scanned = checkpoint(scan(documents))
    found = scanned.join(linked(scanned, scope), ["owner", "print"], "left")
    base = F.concat(*[ordered(k[0], i) for i, k in enumerate(KINDS[:STRONG])])
    none = empty("struct<start:int,kind:int,end:int>")
    return found.select(
        "doc_id",
        *[F.size(k[0]).cast("long").alias(f"n_{k[0]}") for k in KINDS[:STRONG]],
        base.alias("base"),
        F.concat(base, F.coalesce("weak", none)).alias("spans"),
        "owner",
        "print",
    )


def secret_report(documents: DataFrame, scope: int = SCOPE) -> DataFrame:
    found = secret_spans(documents, scope)
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def redacted(documents: DataFrame, scope: int = SCOPE, mask: str = "[SECRET]") -> DataFrame:
    """The documents with every reported span replaced by ``mask``; overlapping spans merge.

    Rows without a span are passed through; only keys and spans of the others are joined.
    ``n_chars``, where present, follows the new text of the rows that changed.
    """
    found = secret_spans(documents, scope).where(F.size("spans") > 0).select("owner", "print", "spans").dropDuplicates(["owner", "print"])
    owner, mark, spans = (free_name(documents, name) for name in ("owner", "print", "spans"))
    found = found.toDF(owner, mark, spans)
    keys = {
        owner: F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
        mark: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))),
    }
    joined = documents.withColumns(keys).join(found, [owner, mark], "left")
    hit = F.col(spans).isNotNull()
    out = joined.withColumn("text", F.when(hit, masked(F.col("text"), F.col(spans), mask)).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in documents.columns])


def masked(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with every span of ``spans`` replaced by ``mask``; overlapping spans merge.

    Cutting a piece out of a string walks to it from the string's start, so spans are merged
    first, then taken in chunks, and a chunk cuts its pieces from its own stretch of the text.
    """

    def between(every: Column) -> Column:
        # The stretches outside all spans: one before each merged span, and the rest of the text.
        reached = running(F.transform(every, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        before = F.zip_with(
            every, reached,
            lambda s, at: F.when(s["start"] >= at, F.struct(at.alias("start"), s["start"].alias("end")).cast(SPAN)),
        )
        last = F.struct(F.array_max(F.transform(every, lambda s: s["end"])).alias("start"), F.length(text).alias("end")).cast(SPAN)
        return F.concat(F.array_compact(before), F.array(last))

    def joined(part: Column) -> Column:
        first = F.element_at(part, 1)["start"]
        stretch = F.substring(text, first + 1, F.element_at(part, -1)["end"] - first)
        cut = lambda of: F.transform(part, lambda s: F.substring(of, s["start"] - first + 1, s["end"] - s["start"]))
        return F.array_join(once(stretch, cut), mask)

    pieces = once(F.array_sort(spans), between)
    return F.array_join(F.transform(chunked(pieces, STRETCH), joined), mask)
