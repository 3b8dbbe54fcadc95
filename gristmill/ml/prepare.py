"""Preparing tables for models: null removal, text codes, train/test split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from gristmill.functions.text import to_text
from gristmill.functions.types import as_list, col, is_numeric, require_columns, require_range
from gristmill.operators.eda import sample_order
from gristmill.plans.ordering import with_row_number
from gristmill.plans.session import checkpoint, is_small, sized
from gristmill.plans.stats import attach, stat

MIN_ROWS = 10
TEST_SIZE = 0.2
FEATURES = "features"
IS_TEST = "is_test"
_PREFIX_VALUES = 16**4


def complete_rows(df: DataFrame, features, target: str | None = None) -> DataFrame:
    """Rows with a value in every used column."""
    names = require_columns(df, as_list(features))
    if not names:
        raise ValueError("choose at least one feature column")
    if target is not None:
        require_columns(df, [target])
        if target in names:
            raise ValueError("the target column cannot be a feature")
    used = [*names, target] if target else names
    return df.na.drop("any", subset=used)


def prepare(df: DataFrame, features, target: str | None = None) -> DataFrame:
    """Complete rows; fewer than ten is an error (checked on ten rows, not by a full count)."""
    rows = complete_rows(df, features, target)
    if rows.limit(MIN_ROWS).count() < MIN_ROWS:
        raise ValueError(f"at least {MIN_ROWS} complete rows are needed")
    return rows


class TextCodes:
    """Sorted integer codes of text columns, kept as one dictionary table.

    ``codes`` has rows ``(column, value, code)``. It may be large, so it is joined, not
    collected; the join is a broadcast only when its rows and bytes allow.
    """

    def __init__(self, columns: Sequence[str], codes: DataFrame | None):
        self.columns, self.codes = list(columns), codes

    @classmethod
    def fit(cls, df: DataFrame, columns) -> TextCodes:
        names = [c for c in as_list(columns) if not is_numeric(df.schema[c])]
        if not names:
            return cls([], None)
        cells = F.array(
            *[
                F.struct(F.lit(n).alias("column"), F.coalesce(to_text(df.schema[n]), F.lit("nan")).alias("value"))
                for n in names
            ]
        )
        # Written once: numbering reads its input three times.
        values = checkpoint(df.select(F.inline(cells)).distinct())
        numbered = with_row_number(values, ["column", "value"], "n")
        first = numbered.groupBy("column").agg(F.min("n").alias("start"))
        # One row per column.
        codes = numbered.join(F.broadcast(first), "column").select(
            "column", "value", (F.col("n") - F.col("start")).alias("code")
        )
        return cls(names, sized(codes))

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace the text columns by their codes; an unseen value is an error."""
        out = df
        for i, name in enumerate(self.columns):
            codes = self.codes.filter(F.col("column") == name).select(
                F.col("value").alias(f"__v{i}"), F.col("code").alias(f"__c{i}")
            )
            if self._small():
                codes = F.broadcast(codes)
            text = F.coalesce(to_text(df.schema[name]), F.lit("nan"))
            out = out.withColumn(f"__t{i}", text).join(
                codes, F.col(f"__t{i}") == F.col(f"__v{i}"), "left"
            )
        exprs = {}
        for i, name in enumerate(self.columns):
            unseen = F.raise_error(
                F.concat(F.lit(f"column '{name}' holds a value unseen in training: "), F.col(f"__t{i}"))
            )
            code = F.col(f"__c{i}")
            exprs[name] = F.when(code.isNull(), unseen.cast("long")).otherwise(code)
        return out.select(*[exprs[c].alias(c) if c in exprs else col(c) for c in df.columns])

    def _small(self) -> bool:
        if not hasattr(self, "_fits"):
            self._fits = is_small(self.codes)
        return self._fits

    def labels(self, column: str) -> DataFrame:
        return self.codes.filter(F.col("column") == column).orderBy("code").select("value", "code")

    def save(self, path: str) -> None:
        if self.codes is not None:
            self.codes.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, columns) -> TextCodes:
        return cls(columns, spark.read.parquet(path) if columns else None)


def encode_features(df: DataFrame, columns) -> tuple[DataFrame, TextCodes]:
    codes = TextCodes.fit(df, columns)
    return codes.transform(df), codes


def assemble(df: DataFrame, features) -> DataFrame:
    names = as_list(features)
    doubles = df.select(
        *[c for c in df.columns if c not in names], *[col(n).cast("double").alias(n) for n in names]
    )
    return VectorAssembler(inputCols=names, outputCol=FEATURES, handleInvalid="error").transform(doubles)


def mark_test_rows(df: DataFrame, order_by, test_size: float = TEST_SIZE) -> DataFrame:
    """Add ``is_test``: exactly ceil(n * test_size) rows, the ones with the smallest key hash.

    Only the counts of 65,536 hash prefixes and the rows of one prefix are ranked to find
    the threshold; the table itself is neither shuffled nor sorted.
    """
    require_range(test_size, 0.05, 0.5, "test_size")
    keys = require_columns(df, as_list(order_by))
    digest = sample_order(keys)
    hashes = df.select(digest.alias("h")).withColumn(
        "p", F.conv(F.substring("h", 1, 4), 16, 10).cast("int")
    )
    counts = hashes.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    # A window over at most 65,536 prefix counts.
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("p")))
    total = counts.agg(F.sum("n").alias("total"))
    wanted = F.ceil(stat("total") * F.lit(float(test_size)))
    edge = (
        attach(upto, total)
        .filter(F.col("upto") >= wanted)
        .agg(F.min_by(F.struct("p", (wanted - (F.col("upto") - F.col("n"))).alias("rest")), F.col("p")).alias("e"))
        .select("e.p", "e.rest")
    )
    inside = attach(hashes, edge).filter(F.col("p") == stat("p"))
    last = (
        inside.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("h")))
        .filter(F.col("r") == stat("rest"))
        .agg(F.max("h").alias("h"))
    )
    return (
        attach(df.withColumn("__h", digest), last)
        .withColumn(IS_TEST, F.col("__h") <= stat("h"))
        .select(*[col(c) for c in df.columns], IS_TEST)
    )


def split(df: DataFrame, order_by, test_size: float = TEST_SIZE) -> tuple[DataFrame, DataFrame]:
    marked = mark_test_rows(df, order_by, test_size)
    return marked.filter(~F.col(IS_TEST)).drop(IS_TEST), marked.filter(IS_TEST).drop(IS_TEST)
