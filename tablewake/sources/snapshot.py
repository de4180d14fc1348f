"""Catalog snapshots, the audit log and report files."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..schemas import AUDIT_LOG, CATALOG

#: A marker without an attempt is that of a snapshot written straight to its number's folder.
MARKERS = "snapshot bigint, attempt string"
MARKER = "_current"
LOG_COLUMNS = (
    "event_id", "database_name", "table_name", "event_name", "event_time", "username", "region", "flagged",
)


def _absent(error: AnalysisException) -> bool:
    """Only a missing path means that nothing has been written yet; any other error must not pass for that."""
    return error.getCondition() == "PATH_NOT_FOUND"


def current_snapshot(spark: SparkSession, root: str) -> int | None:
    """Number of the newest complete snapshot; None before the first."""
    last = _current(spark, root)
    return None if last is None else last[0]


def _folder(root: str, number: int, attempt: str | None) -> str:
    return f"{root}/snapshot={number}" + (f"/attempt={attempt}" if attempt else "")


def _current(spark: SparkSession, root: str) -> tuple[int, str | None] | None:
    """Number and attempt of the newest complete snapshot."""
    try:
        markers = spark.read.schema(MARKERS).json(f"{root}/{MARKER}")
    except AnalysisException as error:
        if not _absent(error):
            raise
        return None
    row = markers.agg(F.max(F.struct("snapshot", "attempt")).alias("last")).first().last
    return None if row is None else (row.snapshot, row.attempt)


class SnapshotTaken(RuntimeError):
    """Another writer has completed a snapshot meanwhile."""


def write_snapshot(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> int:
    """Write all tables as a new snapshot; the marker is written last.

    Readers follow the marker, so they see the old snapshot or the new one, never a mix, and
    a run that fails half way leaves the old snapshot current. Each attempt writes to a folder of its own and overwrites nothing;
    one that finds, before it marks itself, that another has completed a snapshot since it began raises :class:`SnapshotTaken`,
    since its tables were made from an older one.
    """
    last = _current(spark, root)
    number = 0 if last is None else last[0] + 1
    attempt = uuid4().hex
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(_folder(root, number, attempt) + f"/{name}")
    if _current(spark, root) != last:
        raise SnapshotTaken(f"snapshot {number} of {root} exists")
    marker = spark.range(1).select(F.lit(number).cast("bigint").alias("snapshot"), F.lit(attempt).alias("attempt"))
    marker.write.mode("append").json(f"{root}/{MARKER}")
    return number


def read_snapshot(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Tables of the current snapshot; empty ones when there is no snapshot yet."""
    last = _current(spark, root)
    if last is None:
        return {name: spark.createDataFrame([], ddl) for name, ddl in CATALOG.items()}
    folder = _folder(root, *last)
    return {name: spark.read.schema(ddl).parquet(f"{folder}/{name}") for name, ddl in CATALOG.items()}


def snapshot_age(spark: SparkSession, root: str) -> DataFrame:
    """(snapshot, hours) since the current snapshot was completed."""
    markers = spark.read.schema("snapshot bigint").json(f"{root}/{MARKER}")
    latest = markers.select("snapshot", "_metadata.file_modification_time").groupBy().agg(
        F.max_by("snapshot", "snapshot").alias("snapshot"),
        F.max_by("file_modification_time", "snapshot").alias("written"),
    )
    return latest.selectExpr(
        "snapshot", "timestampdiff(SECOND, written, current_timestamp()) / 3600 AS hours"
    )


def upsert_by_job(old: DataFrame, new: DataFrame, stale: DataFrame) -> DataFrame:
    """Replace all rows of the stale jobs by the new rows."""
    return old.join(stale.select("job_id").distinct(), "job_id", "left_anti").unionByName(new)


def log_additions(log: DataFrame, records: DataFrame) -> DataFrame:
    """Records whose (event_id, table_name) the log does not have yet."""
    return records.join(log, ["event_id", "table_name"], "left_anti").select(*records.columns)


def read_audit_log(spark: SparkSession, path: str, but_not: str | None = None) -> DataFrame:
    """The log of all runs, or of all but one."""
    try:
        log = spark.read.schema(f"{AUDIT_LOG}, run string").parquet(path)
    except AnalysisException as error:
        if not _absent(error):
            raise
        log = spark.createDataFrame([], f"{AUDIT_LOG}, run string")
    kept = log if but_not is None else log.where(F.col("run") != but_not)
    return kept.drop("run")


def write_audit_log(spark: SparkSession, path: str, records: DataFrame, run: str) -> None:
    """Add the records of one run that no other run has logged, stamped with the time.

    A run owns the folder ``run=<name>`` and replaces it, so repeating a run is harmless.
    """
    typed = records.select(*LOG_COLUMNS).withColumn("event_time", F.col("event_time").cast("timestamp"))
    new = log_additions(read_audit_log(spark, path, but_not=run), typed)
    stamped = new.withColumn("reported_at", F.current_timestamp())
    stamped.write.mode("overwrite").parquet(f"{path}/run={run}")


def write_report(lines: DataFrame, path: str, *order: str) -> None:
    """Report rows as text files that read in order: a distributed sort, one ``line`` per row."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)
