"""File sources and sinks: csv, json, parquet."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gristmill.functions.casts import text_to_double
from gristmill.functions.types import col, nan_to_null, require_choice
from gristmill.operators.columns import apply_stored_casts
from gristmill.plans.session import checkpoint, sized
from gristmill.sources.records import has_line_breaks, records

FORMATS = ("csv", "json", "parquet")
EXTENSIONS = ("csv", "xlsx", "json", "parquet")
MAX_BYTES = 25 * 1024 * 1024

# Texts that mean "missing" in a csv file.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Leading bytes of the binary formats.
MAGIC = {"xlsx": b"PK\x03\x04", "parquet": b"PAR1"}

ROW_FILE, ROW_NUMBER = "_file", "_row"


def format_of(path: str) -> str:
    extension = path.rstrip("/").rsplit(".", 1)[-1].lower()
    return require_choice(extension, FORMATS, "file format")


def load(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: T.StructType | None = None,
    casts: Mapping[str, str] | None = None,
    multi_line: bool | None = None,
    row_order: bool = False,
    order_by=None,
) -> DataFrame:
    """Read a table, turn NaN into null and re-apply stored casts.

    Quoted fields of csv files may hold line breaks: if a scan finds any, records are put together
    across lines and file ranges (``sources.records``). ``multi_line=False`` says that there are
    none and saves the scan; ``True`` lets Spark read each file in one task. ``row_order`` adds the
    file name and the row number inside the file.
    """
    fmt = require_choice(fmt or format_of(path), FORMATS, "file format")
    if fmt == "csv":
        df = _load_csv(spark, path, schema, multi_line, row_order)
    elif fmt == "json":
        df = _load_json(spark, path, schema)
        if row_order:
            df = df.withColumn(ROW_NUMBER, F.monotonically_increasing_id())
    else:
        reader = spark.read.schema(schema) if schema else spark.read
        df = reader.parquet(path)
        if row_order:
            df = df.select(
                "*",
                F.col("_metadata.file_path").alias(ROW_FILE),
                F.col("_metadata.row_index").alias(ROW_NUMBER),
            )
    df = nan_to_null(df)
    return apply_stored_casts(df, casts, order_by) if casts else df


def _load_csv(spark, path, schema, multi_line, row_order) -> DataFrame:
    options = {"header": True, "escape": '"', "multiLine": bool(multi_line), "inferSchema": False}
    raw = spark.read.options(**options).csv(path)
    names, order = raw.columns, []
    if multi_line is None and has_line_breaks(spark, path):
        raw = _joined_csv(spark, path, names)
        order = [ROW_FILE, ROW_NUMBER] if row_order else []
    elif row_order:
        raw = raw.withColumn(ROW_NUMBER, F.monotonically_increasing_id())
        order = [ROW_NUMBER]
    clean = raw.select(*[F.when(~col(c).isin(*NULL_TOKENS), col(c)).alias(c) for c in names], *order)
    types = {f.name: f.dataType for f in schema} if schema else _inferred_types(clean.select(*[col(c) for c in names]))
    return clean.select(*[_typed(c, types.get(c, T.StringType())) for c in names], *order)


def _joined_csv(spark, path, names) -> DataFrame:
    """Text columns of records that may go over line ends, plus file and position."""
    found = checkpoint(records(spark, path))
    header = found.groupBy("file").agg(F.min("position").alias("header"), F.min_by("record", "position").alias("names"))
    if not header.where(F.col("names").contains("\n")).isEmpty():
        raise ValueError("column names with line breaks need multi_line=True")
    lines = found.join(sized(header.select("file", "header")), "file").where("position > header")
    fields = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    parsed = F.from_csv("record", fields.simpleString()[7:-1].replace(":", " "), {"escape": '"', "multiLine": "true"})
    shown = lines.select(parsed.alias("r"), "file", "position")
    return shown.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)], F.col("file").alias(ROW_FILE), F.col("position").alias(ROW_NUMBER))


def _typed(name: str, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return col(name)
    if isinstance(kind, T.DoubleType):
        return text_to_double(col(name)).alias(name)
    return F.trim(col(name)).try_cast(kind).alias(name)


def _inferred_types(df: DataFrame) -> dict[str, T.DataType]:
    """Whole numbers, numbers, booleans or text, decided by one aggregate over the file."""
    checks = []
    for i, c in enumerate(df.columns):
        checks += [
            F.count(col(c)).alias(f"n{i}"),
            F.count_if(col(c).rlike(r"^\s*[+-]?\d{1,18}\s*$")).alias(f"i{i}"),
            F.count(text_to_double(col(c))).alias(f"d{i}"),
            F.count_if(col(c).isin("True", "False", "TRUE", "FALSE", "true", "false")).alias(f"b{i}"),
        ]
    row = df.agg(*checks).first()
    types = {}
    for i, c in enumerate(df.columns):
        n = row[f"n{i}"]
        if row[f"i{i}"] == n and n:
            types[c] = T.LongType()
        elif row[f"d{i}"] == n:
            types[c] = T.DoubleType()
        elif row[f"b{i}"] == n:
            types[c] = T.BooleanType()
        else:
            types[c] = T.StringType()
    return types


def _load_json(spark, path, schema) -> DataFrame:
    """An array of records, or one record per line."""
    head = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    is_array = bool(head) and head[0]["value"].lstrip().startswith("[")
    reader = spark.read.option("multiLine", is_array)
    return (reader.schema(schema) if schema else reader).json(path)


def save(df: DataFrame, path: str, fmt: str | None = None, mode: str = "overwrite") -> None:
    """Write a directory of part files; never pass the path the table is read from."""
    fmt = require_choice(fmt or format_of(path), FORMATS, "file format")
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.options(header=True, escape='"').csv(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        writer.parquet(path)


def export(df: DataFrame, path: str, fmt: str) -> str:
    """Write a copy in another format."""
    require_choice(fmt, FORMATS, "export format")
    save(df, path, fmt)
    return path


def validate_files(spark: SparkSession, folder: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per file: is its size allowed, its extension known, its content genuine.

    Content is read only for binary formats within the size limit.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(folder)
    )
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    listed = files.select("path", ext.alias("ext"), "length")
    heads = files.filter(F.col("length") <= max_bytes).filter(ext.isin(*MAGIC)).select(
        F.col("path").alias("__path"), F.substring("content", 1, 4).alias("head")
    )
    joined = listed.join(heads, F.col("path") == F.col("__path"), "left")
    genuine = F.lit(True)
    for kind, magic in MAGIC.items():
        genuine = F.when(F.col("ext") == kind, F.col("head") == F.lit(magic)).otherwise(genuine)
    reason = (
        F.when(F.col("length") > max_bytes, "file is larger than the limit")
        .when(~F.col("ext").isin(*EXTENSIONS), "unsupported file extension")
        .when(~F.coalesce(genuine, F.lit(False)), "content does not match the extension")
    )
    return joined.select("path", "ext", "length", reason.isNull().alias("ok"), reason.alias("reason"))
