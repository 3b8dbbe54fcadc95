"""Session settings the library expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores="*", partitions=8, memory="8g") -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("gristmill")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    builder = builder.config("spark.driver.memory", memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of the machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="gristmill-")
    return _local_folders[context.applicationId]


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, survives lost executors, and gives the optimizer the size of
    the table; unlike a checkpointed RDD it carries no inferred constraints, which double
    with every round of an iterative algorithm.
    """
    spark = df.sparkSession
    path = f"{_steps(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _steps(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/gristmill/steps/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete the step tables of this application; DataFrames built on them end with it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_steps(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def sized(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Materialise a lookup table and mark it for broadcast only if it is small.

    Rows and the bytes of its texts are counted on the written copy, so both are exact; a
    larger table keeps the join strategy the optimizer picks (with adaptive skew splitting).
    """
    written = checkpoint(df)
    return F.broadcast(written) if is_small(written, rows, size) else written


def is_small(written: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a written table has at most so many rows and bytes of text."""
    texts = [f.name for f in written.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(0)).cast("long")
    found, used = written.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return found <= rows and used <= size
