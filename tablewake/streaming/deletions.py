"""Structured Streaming form of the audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit
from ..plans.audit_run import REPORT_ORDER, audit_landed
from ..schemas import INVENTORY
from ..sources.scratch import cut
from ..sources.snapshot import read_audit_log, read_snapshot, write_audit_log, write_report


def read_event_stream(
    spark: SparkSession, path: str, max_files: int = 1000, schema: str = INVENTORY["events"]
) -> DataFrame:
    """Event files as they land."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def stream_deletions(events: DataFrame) -> DataFrame:
    """Deletions of a stream; the same operator as for a batch."""
    return audit.parse_deletions(events)


def stream_dedup(deletions: DataFrame, hours: int = 24) -> DataFrame:
    """Each (event, table) once; repeats inside the look-back are dropped.

    State is kept per key until the watermark passes it, so it stays bounded by the
    look-back. The audit itself is exact beyond that: it also asks the log.
    """
    timed = deletions.withColumn("event_time", F.col("event_time").cast("timestamp"))
    return timed.withWatermark("event_time", f"{hours} hours").dropDuplicatesWithinWatermark(
        ["event_id", "table_name"]
    )


def audit_batch(
    spark: SparkSession, events: DataFrame, catalog_root: str, log_path: str, report_root: str,
    batch: int, hours: int = 24, ignore_tables: str | None = None,
) -> None:
    """Audit one batch against the current snapshot.

    All deletions that have landed are audited, late ones too: the batch itself is the look-back of a stream.
    The batch's own log records are not counted as seen and its report and log folders are
    replaced, so a batch that is run again after a failure gives the same result.
    """
    catalog = read_snapshot(spark, catalog_root)
    run_name = f"batch-{batch}"
    log = cut(read_audit_log(spark, log_path, but_not=run_name))
    run = audit_landed(
        audit.deletion_events(events), log, catalog["job_table_edges"], catalog["table_join_edges"],
        catalog["jobs"], catalog["tables"], hours, ignore_tables,
    )
    write_report(run.lines, f"{report_root}/batch={batch}", *REPORT_ORDER)
    write_audit_log(spark, log_path, cut(run.records), run_name)


def stream_audit(
    events: DataFrame, catalog_root: str, log_path: str, report_root: str, checkpoint: str,
    hours: int = 24, ignore_tables: str | None = None, trigger: dict | None = None,
):
    """Start the streaming audit; by default it handles what has landed and stops."""

    def run(batch_events: DataFrame, batch: int) -> None:
        audit_batch(
            batch_events.sparkSession, batch_events, catalog_root, log_path, report_root, batch,
            hours, ignore_tables,
        )

    writer = events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
