"""Versioned datasets: immutable version folders plus an append-only manifest."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from gristmill.functions.types import MutationResult, require_choice, require_range
from gristmill.operators.columns import apply_stored_casts
from gristmill.sources.files import FORMATS, export as export_file, load, save

MANIFEST_SCHEMA = (
    "dataset string, version bigint, action string, details map<string,string>, "
    "casts map<string,string>, parent string, format string, path string, base bigint, ts timestamp"
)
PAGE, MAX_PAGE = 20, 100
# The actions that count as analysis work in the activity summary.
ANALYSIS_ACTIONS = (
    "DIAGNOSE", "AI_ANALYSIS", "CAST", "RENAME_COLUMN", "DROP_DUPLICATES", "REPLACE_VALUES",
    "DROP_NULLS", "FILL_NULLS", "FILL_DERIVED", "TRANSFORM_COLUMN", "SCALE_COLUMNS",
    "EXTRACT_DATETIME", "ENCODE_COLUMNS",
)


class Dataset:
    """A folder ``root/name`` with data under ``v=N`` and its history under ``manifest``."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.root, self.name = spark, root.rstrip("/"), name
        self.folder = f"{self.root}/{name}"

    @classmethod
    def create(
        cls, spark, root, name, df, fmt="parquet", parent=None, casts=None, action="UPLOAD"
    ) -> Dataset:
        require_choice(fmt, FORMATS, "file format")
        dataset = cls(spark, root, name)
        path = f"{dataset.folder}/v=0/{uuid.uuid4().hex}"
        save(df, path, fmt, mode="errorifexists")
        dataset._append(0, action, {}, casts or {}, parent, fmt, path, None)
        return dataset

    def _append(self, version, action, details, casts, parent, fmt, path, base) -> None:
        row = (
            self.name,
            version,
            action,
            {k: str(v) for k, v in details.items()},
            dict(casts),
            parent,
            fmt,
            path,
            base,
            datetime.now(timezone.utc),
        )
        rows = self.spark.createDataFrame([row], MANIFEST_SCHEMA)
        rows.coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def _claim(self, version: int) -> None:
        """Reserve a version: of several writers, the file is created by one only."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/claims/v={version}")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path.getParent())
        if not files.createNewFile(path):
            raise RuntimeError(f"another writer has claimed version {version} of '{self.name}'")

    def release_claim(self, version: int) -> None:
        """Give up the claim of a writer that died before it logged its version."""
        if self.head()["version"] >= version:
            raise ValueError(f"version {version} is in the log")
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/claims/v={version}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False)

    def manifest(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST_SCHEMA).parquet(f"{self.folder}/manifest")

    def head(self):
        return self.manifest().orderBy(F.col("version").desc()).first()

    def entry(self, version: int):
        found = self.manifest().filter(F.col("version") == version).first()
        if found is None:
            raise ValueError(f"dataset '{self.name}' has no version {version}")
        return found

    def read(self, version: int | None = None, order_by=None) -> DataFrame:
        """One version with its stored casts applied."""
        entry = self.head() if version is None else self.entry(version)
        df = load(self.spark, entry["path"], entry["format"])
        casts = entry["casts"] or {}
        return apply_stored_casts(df, casts, order_by) if casts else df

    def commit(
        self,
        result: DataFrame | MutationResult,
        action: str,
        details: Mapping | None = None,
        casts: Mapping[str, str] | None = None,
        counter: str | None = None,
    ) -> int | None:
        """Write the next version and log it; returns its number.

        With a ``MutationResult`` and the name of its count column the commit is skipped
        (None) when nothing changed, before any data is written. Every attempt writes its
        own folder, so a job that died half-way leaves nothing that blocks the next one.
        """
        head = self.head()
        df, details = result, dict(details or {})
        if isinstance(result, MutationResult):
            df = result.df
            if counter:
                changed = result.metrics.agg(F.sum(counter)).first()[0] or 0
                if not changed:
                    return None
                details[counter] = changed
        version = head["version"] + 1
        path = f"{self.folder}/v={version}/{uuid.uuid4().hex}"
        save(df, path, head["format"], mode="errorifexists")
        self._claim(version)
        kept = dict(head["casts"] or {}) if casts is None else casts
        self._append(
            version, action, details, kept, head["parent"], head["format"], path, head["version"]
        )
        return version

    def _restore(self, target, base, action: str) -> int:
        head = self.head()
        version = head["version"] + 1
        self._claim(version)
        self._append(
            version,
            action,
            {"restored_version": target["version"]},
            target["casts"] or {},
            head["parent"],
            target["format"],
            target["path"],
            base,
        )
        return version

    def undo(self) -> int:
        """Restore the state before the current one; repeated calls walk further back."""
        base = self.head()["base"]
        if base is None:
            raise ValueError("there is nothing to undo")
        target = self.entry(base)
        return self._restore(target, target["base"], "REVERT")

    def revert(self, version: int) -> int:
        """Restore a named version as the new head; no data is copied."""
        target = self.entry(version)
        return self._restore(target, self.head()["version"], "REVERT")

    def duplicate(self, name: str | None = None, fmt: str | None = None) -> Dataset:
        head = self.head()
        return Dataset.create(
            self.spark,
            self.root,
            name or f"{self.name}_copy",
            self.read(),
            fmt or head["format"],
            parent=self.name,
            casts=head["casts"] or {},
            action="DUPLICATE",
        )

    def export(self, path: str, fmt: str | None = None) -> str:
        return export_file(self.read(), path, fmt or self.head()["format"])


def activity_log(
    log: DataFrame, dataset: str | None = None, limit: int = PAGE, offset: int = 0
) -> DataFrame:
    """A page of the log, newest first."""
    require_range(limit, 1, MAX_PAGE, "limit")
    if dataset is not None:
        log = log.filter(F.col("dataset") == dataset)
    return log.orderBy(F.col("ts").desc(), F.col("version").desc()).offset(offset).limit(limit)


def activity_rollup(log: DataFrame, as_of: str, days: int = 7, analysis=ANALYSIS_ACTIONS) -> DataFrame:
    """Zero-filled daily counts of all actions and of the analysis actions.

    ``log`` needs ``action`` and ``ts``; ``as_of`` is the last day.
    """
    last = F.to_date(F.lit(as_of))
    counted = (
        log.select(F.to_date("ts").alias("day"), F.col("action").isin(*analysis).alias("counts"))
        .filter(F.col("day").between(F.date_sub(last, days - 1), last))
        .groupBy("day")
        .agg(F.count(F.lit(1)).alias("actions"), F.count_if("counts").alias("analyses"))
    )
    calendar = log.sparkSession.range(1).select(
        F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day")
    )
    zero = F.lit(0).cast("long")
    # At most one row per day.
    return calendar.join(F.broadcast(counted), "day", "left").select(
        "day", F.coalesce("actions", zero).alias("actions"), F.coalesce("analyses", zero).alias("analyses")
    )


def activity_totals(log: DataFrame, as_of: str, days: int = 7, analysis=ANALYSIS_ACTIONS) -> DataFrame:
    """One row: actions, analyses, and both within the trailing days."""
    recent = F.col("ts") >= F.date_sub(F.to_date(F.lit(as_of)), days)
    counts = F.col("action").isin(*analysis)
    return log.agg(
        F.count(F.lit(1)).alias("total_actions"),
        F.count_if(counts).alias("total_analyses"),
        F.count_if(recent).alias("recent_actions"),
        F.count_if(recent & counts).alias("recent_analyses"),
    )


def recent_activity(log: DataFrame, rows: int = 5) -> DataFrame:
    return log.orderBy(F.col("ts").desc(), F.col("version").desc()).limit(rows)
