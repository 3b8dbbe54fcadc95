"""Mixing sources to target weights by distributed prefix sums over hash-random keys.

Every document gets a key that is uniformly random but a function of its id only. Sorted by
that key, each source is an endless shuffled tape; its budget is cut off the front, after
whole rounds over the source where the budget is larger than the source. The tape is never
sorted as a whole: fixed ranges of the key are summed per source, a prefix sum over these
ranges finds the one range that holds the cut, and only that range is sorted. A source with a
third of all rows spreads over as many ranges as any other data of its size.

Defined cases: a null text has size 0 and nothing is taken from it; a null source is a source
of its own, ordered last; an empty table gives an empty result; equal ids share one key, and
if the cut falls on them each takes the same share of what is left, rounded down. Other
columns are ignored or, in ``mixed_documents``, passed on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gristmill.llm.tables import in_batches, small
from gristmill.llm.words import slices, words_of
from gristmill.plans.ordering import with_row_number
from gristmill.plans.session import checkpoint

KEY_DIGITS = 15
ROWS_PER_RANGE = 20_000


def hash_key(id_column: Column) -> Column:
    """A uniformly random long below 16^15, from the id alone."""
    digits = F.substring(F.md5(F.coalesce(id_column.cast("string"), F.lit(""))), 1, KEY_DIGITS)
    return F.conv(digits, 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """A source that is never null, so that joins need no null rule."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source.cast("string")))


def count_words(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns (no text) and ``size``, the number of words of the whole text."""
    chosen = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("text"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts = pa.array(words_of(part.column("text")).counts, pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], counts], [*part.schema.names[:-1], "size"])

    schema = ", ".join(f"k{i} {chosen.schema[i].dataType.simpleString()}" for i in range(len(keep)))
    return in_batches(chosen, sizes, f"{schema}, size long").toDF(*keep, "size")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """``sources(skey, source_size, weight)`` with ``target``.

    The budget is dealt by weight; a source stops at ``cap`` times its size and the excess goes
    to the others by weight, until none is above. Each round is one aggregate of two numbers.
    """
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    budget = share * total
    level = math.inf
    limit = F.col("source_size") * F.lit(float(cap))
    capped = -1
    while True:
        full = F.lit(level) * F.col("weight") > limit if math.isfinite(level) else F.lit(False)
        n, used, free = sources.agg(
            F.count_if(full),
            F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
        ).first()
        if n == capped or free == 0:
            break
        capped = n
        level = (budget - cap * used) / free
    if not math.isfinite(level):
        return sources.withColumn("target", F.lit(0.0))
    if free == 0:
        return sources.withColumn("target", limit)
    return sources.withColumn("target", F.least(limit, F.lit(level) * F.col("weight")))


def cuts(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """One row per source: its size and target, whole rounds, and where the last round is cut.

    ``sized`` is a written table ``(key, skey, size)``. A document takes ``rounds`` times its
    size, plus its size if its key is below ``cut_key``, plus its share of ``cut_rest`` out of
    ``cut_size`` if its key is the cut.
    """
    per_source = checkpoint(sized.groupBy("skey").agg(F.sum("size").alias("source_size")))
    ranked = with_row_number(per_source.where("skey <> ''"), ["skey"], "rank")
    named = per_source.where("skey <> ''").count()
    ranked = ranked.unionByName(per_source.where("skey = ''").withColumn("rank", F.lit(named).cast(ranked.schema["rank"].dataType)))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    planned = checkpoint(
        targets(checkpoint(ranked.select("skey", "source_size", weight.cast("long").alias("weight"))), weights, share, cap)
        .withColumn("words", F.floor("target").cast("long"))
        .withColumn("rounds", F.when(F.col("source_size") > 0, F.expr("words DIV source_size")).otherwise(F.lit(0)))
        .withColumn("rest", F.col("words") - F.col("rounds") * F.col("source_size"))
    )
    rows = sized.count()
    ranges = max(1, math.ceil(rows / ROWS_PER_RANGE))
    slot = F.least(F.floor(F.col("key") / F.lit(float(16**KEY_DIGITS)) * F.lit(ranges)), F.lit(ranges - 1)).cast("long")
    dealt = sized.withColumn("slot", slot)
    along = Window.partitionBy("skey").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = dealt.groupBy("skey", "slot").agg(F.sum("size").alias("slot_size")).withColumn("upto", F.sum("slot_size").over(along))
    hit = small(
        sums.join(planned.select("skey", "rest"), "skey")
        .where("rest > 0 AND upto >= rest AND upto - slot_size < rest")
        .select("skey", "slot", (F.col("upto") - F.col("slot_size")).alias("before"), "rest")
    )
    inside = Window.partitionBy("skey").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    exact = (
        dealt.join(hit, ["skey", "slot"])
        .groupBy("skey", "key", "before", "rest").agg(F.sum("size").alias("cut_size"))
        .withColumn("upto", F.col("before") + F.sum("cut_size").over(inside))
        .where("upto >= rest AND upto - cut_size < rest")
        .select("skey", F.col("key").alias("cut_key"), "cut_size", (F.col("rest") - F.col("upto") + F.col("cut_size")).alias("cut_rest"))
    )
    return planned.join(exact, "skey", "left").select("skey", "source_size", "target", "rounds", "cut_key", "cut_size", "cut_rest")


def taken_words() -> Column:
    """Words the mix takes of a document, from its size, key and its source's cut."""
    return F.col("rounds") * F.col("size") + F.coalesce(
        F.when(F.col("key") < F.col("cut_key"), F.col("size")),
        F.when(F.col("key") == F.col("cut_key"), F.expr("(size * cut_rest) DIV cut_size")),
        F.lit(0),
    )


def mix(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """Per document: ``doc_id, source, size, source_size, target, taken``."""
    sized = checkpoint(
        count_words(documents, ["doc_id", "source"])
        .withColumn("key", hash_key(F.col("doc_id")))
        .withColumn("skey", source_key(F.col("source")))
    )
    plan = small(cuts(sized, weights, share, cap))
    joined = sized.join(plan, "skey", "left")
    return joined.select("doc_id", "source", "size", "source_size", "target", taken_words().alias("taken"))


WORD = r"[^\x20\x09-\x0D]+"


def mixed_documents(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """The mix itself: the columns of ``documents`` plus ``epoch, words``, one row per copy taken.

    A copy that is cut holds its first ``words`` words, joined by one space; all others keep
    their text. Documents of which nothing is taken are absent. Existing columns called
    ``epoch`` or ``words`` are replaced.
    """
    rows = documents.select(F.col("doc_id"), F.col("source"), F.col("text"))
    sized = checkpoint(
        count_words(rows, ["doc_id", "source"])
        .withColumn("key", hash_key(F.col("doc_id")))
        .withColumn("skey", source_key(F.col("source")))
    )
    plan = small(cuts(sized, weights, share, cap).withColumnsRenamed({c: f"__{c}" for c in ("source_size", "target", "rounds", "cut_key", "cut_size", "cut_rest", "skey")}))
    # Only the table of cuts moves; the size of a text is counted again where the text lies.
    whole = documents.drop("epoch", "words").where(F.col("text").rlike(WORD)).withColumn("__key", hash_key(F.col("doc_id"))).withColumn("__of", source_key(F.col("source")))
    parts = F.size(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD), F.lit(0)))
    on_cut = F.col("__key") == F.col("__cut_key")
    joined = whole.join(plan, F.col("__of") == F.col("__skey"), "left").withColumn(
        "__copies", F.col("__rounds") + F.when((F.col("__key") <= F.col("__cut_key")), F.lit(1)).otherwise(F.lit(0))
    )
    copies = joined.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.when(F.col("__copies") > 0, F.col("__copies")))))
    last = on_cut & (F.col("epoch") > F.col("__rounds"))
    words = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD), F.lit(0))
    some = F.when(last, F.floor(parts * F.col("__cut_rest") / F.col("__cut_size"))).cast("int")
    cut = F.array_join(F.slice(words, F.lit(1), some), " ")
    shown = copies.withColumn("words", some).withColumn("text", F.when(last, cut).otherwise(F.col("text")))
    shown = shown.where("words IS NULL OR words > 0")
    names = [c for c in documents.columns if c.lower() not in ("epoch", "words")]
    length = {"n_chars": F.when(F.col("words").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in names else {}
    return shown.withColumns(length).select(*[F.col(f"`{c}`") for c in names], "epoch", "words")
