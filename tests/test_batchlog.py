"""Audit tables as committed batches: writers side by side, failures between write and commit, snapshots."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from lakewarden.operators.catalog import RECORD_INDEX
from lakewarden.operators.index import add_record_index
from lakewarden.plans.audit import AuditLog, latest
from lakewarden.plans.batchlog import BatchLog
from lakewarden.plans.messages import distinct_messages
from lakewarden.sources.files import Files


@pytest.fixture
def audit(spark, tmp_path):
    return AuditLog(spark, location=str(tmp_path / "audit"))


def test_writers_side_by_side_lose_and_double_nothing(spark, audit, tmp_path):
    others = [audit, AuditLog(spark.newSession(), location=str(tmp_path / "audit"))]
    threads = [threading.Thread(target=others[k % 2].mark, args=("received", [f"s{k}", f"t{k}"])) for k in range(8)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    found = sorted(r.submission_id for r in audit.table("processing_status").collect())
    assert found == sorted([f"s{k}" for k in range(8)] + [f"t{k}" for k in range(8)])


def test_a_batch_counts_once_however_often_it_is_tried(spark, audit, monkeypatch):
    rows = [{"submission_id": "a", "processing_status": "received"}]
    plain, calls = Files.create_new, []

    def unlucky(self, path, text):
        calls.append(path)
        if len(calls) == 1:
            raise OSError("killed between write and commit")
        done = plain(self, path, text)
        if len(calls) == 2:
            raise OSError("committed, but the answer is lost")
        return done

    monkeypatch.setattr(Files, "create_new", unlucky)
    for _ in range(2):
        with pytest.raises(OSError):
            audit.add("processing_status", rows, batch="b1")
        assert audit.table("processing_status").count() == (len(calls) == 2)
    audit.add("processing_status", rows, batch="b1")
    assert audit.table("processing_status").count() == 1 and len(calls) == 2


def test_errors_other_than_a_lost_race_are_not_swallowed(spark, audit):
    with pytest.raises(Exception, match="nothing_such"):
        audit.append("transfers", spark.range(1).select(F.lit("x").alias("submission_id"), F.expr("raise_error('nothing_such')").alias("report_name")))
    assert audit.table("transfers").count() == 0


def test_one_of_two_creators_of_a_file_succeeds(spark, tmp_path):
    files, path = Files(spark), str(tmp_path / "log" / "x")
    assert files.create_new(path, "one") and not files.create_new(path, "two")
    assert files.read_text(path) == "one" and [f for f in (tmp_path / "log").iterdir() if f.name.startswith(".")] == []


def test_snapshots_equal_the_whole_history_and_read_less(spark, tmp_path, rows):
    schema = AuditLog.schema("processing_status")
    log = BatchLog(spark, str(tmp_path / "t"), schema, latest)
    assert log.read().count() == log.latest().count() == 0 and not log.snapshot()
    day = dt.date(2024, 5, 1)
    frame = spark.range(120).select(
        F.concat(F.lit("s"), F.col("id") % 17).alias("submission_id"), F.expr("date_add(DATE'2024-05-01', int(id % 7))").alias("date_updated"),
        F.expr("timestamp(date_add(DATE'2024-05-01', int(id % 7))) + make_interval(0, 0, 0, 0, 0, id)").alias("time_updated"), F.col("id").cast("string").alias("processing_status"), "id",
    )
    for k in range(5):
        log.append(frame.where(F.col("id") % 5 == k))
        if k in (1, 3):
            assert log.snapshot()
        whole = latest(log.read())
        assert rows(log.latest()) == rows(whole) and log.read().count() == 24 * (k + 1)
        since = day + dt.timedelta(days=4)
        assert rows(log.latest(since)) == rows(whole.where(F.col("date_updated") >= F.lit(since)))
    assert not any("/history/" in f for f in log.latest().inputFiles()) and sum("/data/" in f for f in log.latest().inputFiles()) <= 4
    plan = log.latest(day + dt.timedelta(days=6))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date_updated" in plan


def test_a_snapshot_that_comes_second_changes_nothing(spark, tmp_path):
    log = BatchLog(spark, str(tmp_path / "t"), AuditLog.schema("transfers"), latest)
    log.append(spark.sql("SELECT 'a' AS submission_id, DATE'2024-01-01' AS date_updated"))
    before = log._snapshot()
    assert log.snapshot()
    late = BatchLog(spark, str(tmp_path / "t"), log.schema, latest)
    late._snapshot = lambda: before
    assert not late.snapshot() and log.read().count() == 1 == log.latest().count()


def test_messages_keep_the_order_they_first_occur_in(spark):
    rows = [(3, 1, "b"), (1, 2, "a"), (2, 9, "b"), (1, 1, "c"), (4, 1, "a"), (2, 8, None), (5, 5, None)]
    frame = spark.createDataFrame(rows, "file int, place int, text string").repartition(3)
    out = distinct_messages(frame, order=("file", "place"))
    assert out.columns == frame.columns
    assert [tuple(r) for r in out.collect()] == [(1, 1, "c"), (1, 2, "a"), (2, 8, None), (2, 9, "b")]


def test_record_index_runs_no_job_over_a_table(spark, tmp_path):
    spark.range(1000).repartition(7).withColumn("x", F.col("id") * 2).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("index", "index")
    out = add_record_index(table.select("x", F.col("_metadata.file_path").alias("file")))
    assert len(tracker.getJobIdsForGroup("index")) == 0
    spark.sparkContext._jsc.clearJobGroup()
    assert out.columns == ["x", "file", RECORD_INDEX] and sorted(r[2] for r in out.collect()) == list(range(1, 1001))
    places = [r for r in out.groupBy("file").agg(F.min(RECORD_INDEX), F.max(RECORD_INDEX), F.count("*")).orderBy("file").collect()]
    assert all(r[2] - r[1] + 1 == r[3] for r in places) and [r[1] for r in places] == sorted(r[1] for r in places)


def test_record_index_of_a_shuffle_is_fixed_once(spark):
    frame = spark.range(500).repartition(5).withColumn("draw", F.rand())
    out = add_record_index(frame)
    first, again = ({r.id: r[RECORD_INDEX] for r in out.collect()} for _ in range(2))
    assert first == again and sorted(first.values()) == list(range(1, 501))
    kept = add_record_index(out.drop(RECORD_INDEX).where("id % 3 = 0"))
    assert sorted(r[RECORD_INDEX] for r in kept.collect()) == list(range(1, 168))
