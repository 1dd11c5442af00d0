"""Audit: four append-only tables and views of the latest records.

Each table is a log of committed batches (``batchlog``): appends never change a row or wait for each other, and those with
an id can be tried again. The latest record of each submission comes from the last snapshot and the batches after it, by one
aggregation with ``max_by``; :meth:`AuditLog.snapshot` makes a new one.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.plans.batchlog import BatchLog

STATUSES = ("received", "file_transformation", "data_contract", "business_rules", "error_report", "success", "failed", "archived")
RESULTS = ("success", "validation_failed", "processing_failed", "archived")
_BASE = "submission_id string, date_updated date, time_updated timestamp"
TABLES = {
    "processing_status": "processing_status string, job_run_id long, submission_result string",
    "submission_info": "dataset_id string, file_name string, file_extension string, submission_method string, submitting_org string, reporting_period_start string, reporting_period_end string, file_size long, datetime_received timestamp",
    "submission_statistics": "record_count long, number_submission_rejections long, number_record_rejections long, number_warnings long",
    "transfers": "report_name string, transfer_id string, transfer_method string, recipient string",
}

#: Comparisons that lookups may use.
_TESTS = {
    "==": lambda c, v: c == F.lit(v), "!=": lambda c, v: c != F.lit(v), "<": lambda c, v: c < F.lit(v), "<=": lambda c, v: c <= F.lit(v),
    ">": lambda c, v: c > F.lit(v), ">=": lambda c, v: c >= F.lit(v), "in": lambda c, v: c.isin(*v), "is null": lambda c, _: c.isNull(),
}


def predicate(tests: Iterable[tuple[str, str, Any]]) -> Column:
    """``(column, comparison, value)`` tests, all of which must hold."""
    total = F.lit(True)
    for name, test, value in tests:
        total &= _TESTS[test](F.col(name), value)
    return total


def latest(frame: DataFrame, by: Sequence[str] = ("submission_id",), order: Sequence[str] = ("time_updated",)) -> DataFrame:
    """The newest row of each key: one aggregation, without sorting the group. Of rows as new as each other the one
    with the greatest values in the other columns, in their order, is taken."""
    others = [c for c in frame.columns if c not in by]
    newest = F.max_by(F.struct(*others), F.struct(*order, *[c for c in others if c not in order])).alias("newest")
    return frame.groupBy(*by).agg(newest).select(*by, "newest.*").select(*frame.columns)


def bucket_of(submission_id: Column, buckets: int) -> Column:
    """The bucket of a hexadecimal id, from its last 15 digits (60 bits)."""
    return F.pmod(F.conv(F.right(F.translate(submission_id, "-", ""), F.lit(15)), 16, 10).cast("bigint"), F.lit(buckets))


class AuditLog:
    """The audit tables of a database, or of a folder."""

    def __init__(self, spark: SparkSession, database: str = "default", pool: str = "audit", location: str | None = None):
        self.spark = spark
        base = location or spark.catalog.getDatabase(database).locationUri
        self._logs = {name: BatchLog(spark, f"{base.rstrip('/')}/{pool}_{name}", self.schema(name), latest) for name in TABLES}

    @staticmethod
    def schema(table: str) -> T.StructType:
        return T.StructType.fromDDL(f"{_BASE}, {TABLES[table]}")

    def table(self, table: str) -> DataFrame:
        return self._logs[table].read()

    def latest(self, table: str, since: dt.date | None = None) -> DataFrame:
        """The latest record of each submission, perhaps only those since a date."""
        return self._logs[table].latest(since)

    def append(self, table: str, frame: DataFrame, batch: str | None = None) -> str:
        """Append a frame as one batch, now unless it has times of its own. A batch id that is given makes it safe to try again."""
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        if "time_updated" not in frame.columns:
            frame = frame.withColumn("time_updated", F.lit(now.isoformat()).cast("timestamp"))
        if "date_updated" not in frame.columns:
            frame = frame.withColumn("date_updated", F.to_date("time_updated"))
        return self._logs[table].append(frame, batch)

    def add(self, table: str, rows: Sequence[Mapping[str, Any]], batch: str | None = None) -> None:
        """Append a few rows, one file for all."""
        if rows:
            now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
            schema = self.schema(table)
            data = [tuple({"date_updated": now.date(), "time_updated": now, **row}.get(f.name) for f in schema) for row in rows]
            self._logs[table].append(self.spark.createDataFrame(data, schema).coalesce(1), batch)

    def snapshot(self) -> None:
        """Merge what was appended to each table since its last snapshot."""
        for log in self._logs.values():
            log.snapshot()

    def mark(self, status: str, submission_ids: Iterable[str], result: str | None = None, job_run_id: int | None = None) -> None:
        if status not in STATUSES:
            raise ValueError(f"unknown status {status!r}")
        if result is not None and result not in RESULTS:
            raise ValueError(f"unknown result {result!r}")
        self.add("processing_status", [{"submission_id": s, "processing_status": status, "submission_result": result, "job_run_id": job_run_id} for s in submission_ids])

    def add_transfer(self, submission_id: str, report_name: str, transfer_id: str, transfer_method: str, recipient: str | None = None) -> None:
        self.add("transfers", [{"submission_id": submission_id, "report_name": report_name, "transfer_id": transfer_id, "transfer_method": transfer_method, "recipient": recipient}])

    def latest_status(self) -> DataFrame:
        return self.latest("processing_status")

    def with_info(self, frame: DataFrame) -> DataFrame:
        """Submission details beside ``frame``; equal columns are those of ``frame``."""
        info = self.latest("submission_info")
        return frame.join(info.select("submission_id", *[c for c in info.columns if c not in frame.columns]), "submission_id")

    def queue(self, status: str) -> DataFrame:
        """Submissions whose latest status is this."""
        return self.with_info(self.latest_status().where(F.col("processing_status") == status))

    def lookup(self, table: str, tests: Iterable[tuple[str, str, Any]], newest_only: bool = True) -> DataFrame:
        return (self.latest(table) if newest_only else self.table(table)).where(predicate(tests))

    def downstream_pending(self, max_days_old: int, run_number: int = 0, max_concurrency: int = 1, statuses: Sequence[str] = ("received", "file_transformation", "data_contract", "business_rules", "error_report")) -> DataFrame:
        """Recent submissions that are not done, of one of the buckets that concurrent runs share."""
        since = dt.date.today() - dt.timedelta(days=max_days_old)
        open_now = self.latest("processing_status", since).where(F.col("processing_status").isin(*statuses))
        return open_now.where(bucket_of(F.col("submission_id"), max_concurrency) == run_number)

    def export(self, submission_id: str, folder: str) -> list[str]:
        """Each table's rows of a submission as Parquet."""
        places = []
        for name in TABLES:
            places.append(f"{folder}/{name}.parquet")
            self.table(name).where(F.col("submission_id") == submission_id).write.mode("overwrite").parquet(places[-1])
        return places
