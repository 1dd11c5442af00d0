"""Arrow files and streams read by tasks, one or more record batches each.

The driver reads the headers of the messages only (some hundred bytes a batch, with seeks over the bodies); a task reads the
schema, the dictionaries and its own batches. The IPC file format is a stream between two magic strings, so one scan serves
both.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of batches that make a task.
TASK_BYTES = 64 << 20
# Fixed values of the format: the file's magic string, the mark before each message, and the kinds of messages.
MAGIC, MARK = b"ARROW1", 0xFFFFFFFF
SCHEMA, DICTIONARY, BATCH = 1, 2, 3


def _kind_and_body(metadata: bytes) -> tuple[int, int]:
    """The kind of a message and the length of its body, from its flat buffer: fields 1 and 3 of the root table."""
    (root,) = struct.unpack_from("<I", metadata)
    (back,) = struct.unpack_from("<i", metadata, root)
    (size,) = struct.unpack_from("<H", metadata, root - back)

    def field(number: int, form: str) -> int:
        at = 4 + 2 * number
        offset = struct.unpack_from("<H", metadata, root - back + at)[0] if at < size else 0
        return struct.unpack_from(form, metadata, root + offset)[0] if offset else 0

    return field(1, "<B"), field(3, "<q")


def messages(source: pa.NativeFile) -> Iterator[tuple[int, int, int]]:
    """(kind, offset, length) of each message of a stream or file."""
    at = 8 if source.read(6) == MAGIC else 0
    while True:
        source.seek(at)
        head = source.read(8)
        if len(head) < 4:
            return
        (mark,) = struct.unpack_from("<I", head)
        size = struct.unpack("<I", head[4:8])[0] if mark == MARK and len(head) == 8 else mark
        prefix = 8 if mark == MARK else 4
        if size == 0 or (mark == MARK and len(head) < 8):
            return
        source.seek(at + prefix)
        kind, body = _kind_and_body(source.read(size))
        yield kind, at, prefix + size + body
        at += prefix + size + body


def _plain(schema: pa.Schema) -> pa.Schema:
    """Dictionary columns as what they stand for."""
    return pa.schema([pa.field(f.name, f.type.value_type if pa.types.is_dictionary(f.type) else f.type, f.nullable) for f in schema])


def read_arrow(spark: SparkSession, place: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """An Arrow IPC stream or file as a DataFrame. The place must be one that pyarrow opens on every executor."""
    uri = place if "://" in place else f"file://{Path(place).absolute()}"
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as source:
        found = list(messages(source))
        leading = [(at, length) for kind, at, length in found if kind in (SCHEMA, DICTIONARY)]
        source.seek(leading[0][0])
        schema = pa.ipc.read_schema(pa.py_buffer(source.read(leading[0][1])))
    batches = [(at, length) for kind, at, length in found if kind == BATCH]
    target = spark.createDataFrame(_plain(schema).empty_table()).schema
    if not batches:
        return spark.createDataFrame([], target)
    arrow = to_arrow_schema(target)

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(uri)
        with store.open_input_file(path) as source:

            def bytes_at(at: int, length: int) -> bytes:
                source.seek(at)
                return source.read(length)

            before = b"".join(bytes_at(*place) for place in leading)
            for ranges in rows:
                for at, length in zip(ranges.column(0).to_pylist(), ranges.column(1).to_pylist(), strict=True):
                    with pa.ipc.open_stream(pa.py_buffer(before + bytes_at(at, length) + struct.pack("<II", MARK, 0))) as reader:
                        for batch in reader:
                            columns = [c.dictionary_decode() if pa.types.is_dictionary(c.type) else c for c in batch.columns]
                            yield from pa.Table.from_arrays(columns, names=arrow.names).cast(arrow).to_batches()

    tasks = max(1, min(len(batches), sum(length for _, length in batches) // task_bytes))
    ranges = spark.createDataFrame(batches, "at long, length long")
    return ranges.repartitionByRange(tasks, "at").mapInArrow(read, target)
