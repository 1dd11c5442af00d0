"""Arrow reference data read by tasks, in both formats."""

import datetime as dt

import pyarrow as pa
import pytest

from lakewarden.sources import arrowfiles


def batches(n, rows):
    kinds = pa.array(["x", "y", None]).dictionary_encode()
    for k in range(n):
        place = list(range(k * rows, (k + 1) * rows))
        yield pa.record_batch(
            {"id": pa.array(place), "kind": pa.DictionaryArray.from_arrays(pa.array([None if p % 3 == 2 else p % 3 for p in place], pa.int32()), kinds.dictionary),
             "t": pa.array([dt.datetime(2024, 1, 1, p % 24) for p in place], pa.timestamp("ns")), "l": pa.array([["a"] * (p % 3) for p in place], pa.large_list(pa.large_string()))}
        )


@pytest.mark.parametrize("form", [pa.ipc.new_stream, pa.ipc.new_file])
def test_batches_are_read_by_tasks(spark, tmp_path, rows, form, monkeypatch):
    path, made = str(tmp_path / "a.arrow"), list(batches(9, 200))
    with pa.OSFile(path, "wb") as out, form(out, made[0].schema) as writer:
        for batch in made:
            writer.write_batch(batch)
    with pa.memory_map(path) as source:
        found = list(arrowfiles.messages(source))
    assert [kind for kind, _, _ in found if kind == arrowfiles.BATCH] == [3] * 9 and found[0][0] == arrowfiles.SCHEMA
    frame = arrowfiles.read_arrow(spark, path, task_bytes=4000)
    assert frame.rdd.getNumPartitions() > 4
    whole = spark.createDataFrame(pa.Table.from_batches(made).cast(arrowfiles._plain(made[0].schema)))
    assert frame.schema == whole.schema and rows(frame) == rows(whole) and frame.count() == 1800


def test_a_stream_without_batches(spark, tmp_path):
    path = str(tmp_path / "none.arrow")
    with pa.OSFile(path, "wb") as out, pa.ipc.new_stream(out, pa.schema([("x", pa.int64())])):
        pass
    frame = arrowfiles.read_arrow(spark, path)
    assert frame.columns == ["x"] and frame.count() == 0
