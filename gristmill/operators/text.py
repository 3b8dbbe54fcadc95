"""Operators on tables of messages and generated text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gristmill.functions.types import as_list, col, require_columns
from gristmill.plans.ordering import top_per_group

HISTORY_TURNS = 10
# How the two roles are labelled in a rendered history.
USER_LABEL, OTHER_LABEL = "User", "Assistant"
# Fixed value: a numbered question line.
NUMBERED_LINE = r"^\s*Q\d+[:.]\s*(.+?)\s*$"


def history_window(
    df: DataFrame, conversation: str, turn: str, role: str, text: str, turns: int = HISTORY_TURNS
) -> DataFrame:
    """The last turns of each conversation in order, rendered one line per turn.

    The rank limit runs before the shuffle, so a long conversation is cut early.
    """
    require_columns(df, [conversation, turn, role, text])
    label = F.when(F.lower(col(role)) == "user", USER_LABEL).otherwise(OTHER_LABEL)
    kept = top_per_group(df, [conversation], [col(turn).desc()], turns, "__n")
    rendered = F.struct(col(turn).alias("t"), F.concat(label, F.lit(": "), col(text)).alias("line"))
    grouped = kept.groupBy(col(conversation).alias(conversation)).agg(
        F.sort_array(F.collect_list(rendered)).alias("__lines")
    )
    return grouped.select(
        col(conversation),
        F.size("__lines").cast("long").alias("turns"),
        F.array_join(F.transform("__lines", lambda x: x["line"]), "\n").alias("history"),
    )


def parse_numbered_lines(df: DataFrame, key, text: str) -> DataFrame:
    """Questions from ``Q<n>:`` / ``Q<n>.`` lines, one per text ignoring case, first wins."""
    keys = require_columns(df, as_list(key))
    require_columns(df, [text])
    lines = df.select(
        *[col(k) for k in keys], F.posexplode(F.split(col(text), r"\r\n|\r|\n")).alias("position", "line")
    ).filter(F.col("line").rlike(NUMBERED_LINE))
    questions = lines.withColumn("question", F.regexp_extract("line", NUMBERED_LINE, 1))
    grouped = questions.groupBy(*[col(k) for k in keys], F.lower("question").alias("__same")).agg(
        F.min_by(F.struct("position", "question"), F.col("position")).alias("__first")
    )
    return grouped.select(
        *[col(k) for k in keys],
        F.col("__first.position").cast("long").alias("position"),
        F.col("__first.question").alias("question"),
    )
