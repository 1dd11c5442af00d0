"""Reports over messages: the projection users see, aggregates, the summary matrix, and a spreadsheet."""

from __future__ import annotations

import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any
from xml.sax.saxutils import escape

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.sources.files import Files, scratch

# The names of message types and the verdicts on a submission.
FILE_REJECTION, RECORD_REJECTION, WARNING = "File Rejection", "Record Rejection", "Warning"
PROCESSING_FAILED = "There was an issue processing the submission. Please contact support."
REJECTED = "File has been rejected"
ACCEPTED_WITH_REJECTIONS = "File has been accepted with record rejections"
ACCEPTED_WITH_WARNINGS = "File has been accepted, all records accepted with warnings"
ACCEPTED = "File has been accepted, no issues to report"

SHEET_ROWS = 1_000_000
#: Rows of the last sheet that a task renders, about.
FETCHED_ROWS = 50_000


def project(messages: DataFrame) -> DataFrame:
    """Messages as report rows: Table, Type, Error_Code, Data_Item, Error, Record_Index, Value, ID, Category."""
    kind = F.when(F.col("Status") == "informational", WARNING).when(F.col("FailureType") == "submission", FILE_REJECTION).otherwise(RECORD_REJECTION)
    return messages.select(
        F.col("Entity").alias("Table"), kind.alias("Type"), F.col("ErrorCode").alias("Error_Code"), F.col("ReportingField").alias("Data_Item"),
        F.col("ErrorMessage").alias("Error"), F.col("RecordIndex").alias("Record_Index"), "Value", F.col("Key").alias("ID"), "Category",
    )


def fill_codes(report: DataFrame, codes: DataFrame) -> DataFrame:
    """Codes and texts from a table (Data_Item, Category, Error_Code, Error) where the report has none; of several rows for an item
    and category the one with the least code, then text."""
    least = F.min(F.struct("Error_Code", "Error")).alias("least")
    known = codes.groupBy("Data_Item", "Category").agg(least).alias("known")
    joined = report.alias("report").join(known, ["Data_Item", "Category"], "left")
    fills = {name: F.coalesce(F.col(f"report.`{name}`"), F.col(f"known.least.`{name}`")).alias(name) for name in ("Error_Code", "Error")}
    return joined.select(*[fills.get(c, F.col(c) if c in ("Data_Item", "Category") else F.col(f"report.`{c}`")) for c in report.columns])


def aggregates(report: DataFrame) -> DataFrame:
    """Counts by type, table, item, category and code, the largest first within a type."""
    counted = report.groupBy("Type", "Table", "Data_Item", "Category", "Error_Code").agg(F.count(F.lit(1)).alias("Count"))
    return counted.orderBy(F.asc("Type"), F.desc("Count"))


def type_totals(aggregated: DataFrame) -> DataFrame:
    return aggregated.groupBy("Type").agg(F.sum("Count").alias("Count"))


def summary_matrix(aggregated: DataFrame, tables: Sequence[str]) -> DataFrame:
    """Types by tables, with zeros."""
    return aggregated.groupBy("Type").pivot("Table", list(tables)).agg(F.sum("Count")).na.fill(0)


def verdict(types: Iterable[str], processing_failed: bool = False) -> str:
    """The gravest of what was found."""
    if processing_failed:
        return PROCESSING_FAILED
    found = set(types)
    for kind, text in ((FILE_REJECTION, REJECTED), (RECORD_REJECTION, ACCEPTED_WITH_REJECTIONS), (WARNING, ACCEPTED_WITH_WARNINGS)):
        if kind in found:
            return text
    return ACCEPTED


def verdicts(report: DataFrame, *by: str) -> DataFrame:
    """The verdict on every submission at once: ``by`` names it, and a submission nothing was found in has one row of null type.
    One aggregation, combined before the shuffle, so a submission with most of the messages costs no more than others."""
    grave = F.max(F.when(F.col("Type") == FILE_REJECTION, 3).when(F.col("Type") == RECORD_REJECTION, 2).when(F.col("Type") == WARNING, 1).otherwise(0))
    text = F.element_at(F.array(*[F.lit(t) for t in (ACCEPTED, ACCEPTED_WITH_WARNINGS, ACCEPTED_WITH_REJECTIONS, REJECTED)]), F.col("__grave") + 1)
    return report.groupBy(*[F.col(f"`{c}`") for c in by]).agg(grave.alias("__grave")).select(*[F.col(f"`{c}`") for c in by], text.alias("verdict"))


def statistics(aggregated: DataFrame, record_count: int | None) -> dict[str, int] | None:
    """The audit's counts, or None where no record was read."""
    if not record_count:
        return None
    totals = {r["Type"]: r["Count"] for r in type_totals(aggregated).collect()}
    return {
        "record_count": record_count, "number_submission_rejections": totals.get(FILE_REJECTION, 0),
        "number_record_rejections": totals.get(RECORD_REJECTION, 0), "number_warnings": totals.get(WARNING, 0),
    }


# Spreadsheet


def _column_name(k: int) -> str:
    name = ""
    while True:
        k, letter = divmod(k, 26)
        name = chr(65 + letter) + name
        if not k:
            return name
        k -= 1


def _cell(row: int, column: int, value: Any) -> str:
    place = f"{_column_name(column)}{row}"
    if value is None:
        return ""
    if isinstance(value, int | float) and not isinstance(value, bool):
        return f'<c r="{place}"><v>{value}</v></c>'
    text = "".join(c for c in str(value) if c >= " " or c in "\t\n\r")
    return f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


_SHEET_BEGINS = f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>'
_SHEET_ENDS = "</sheetData></worksheet>"


def _row(number: int, values: Sequence[Any]) -> str:
    return f'<row r="{number}">{"".join(_cell(number, k, v) for k, v in enumerate(values))}</row>'


@dataclass
class Rendered:
    """Sheets whose rows tasks have rendered and deflated: the first row, and for each sheet its files in order (path, bytes as text, CRC-32)."""

    header: Sequence[Any]
    sheets: list[list[tuple[str, int, int]]] = field(default_factory=list)


def _joined_crc(first: int, second: int, length: int) -> int:
    """The CRC-32 of two texts, one after the other, from theirs; ``length`` is that of the second."""

    def times(a: int, b: int) -> int:
        product = 0
        for k in range(31, -1, -1):
            product ^= b if a >> k & 1 else 0
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return product

    power, square, n = 1 << 31, 1 << 30, 8 * length
    while n:
        power = times(square, power) if n & 1 else power
        square, n = times(square, square), n >> 1
    return times(power, first) ^ second


def _write_rendered(book: zipfile.ZipFile, name: str, begins: bytes, files: Files, parts: Sequence[tuple[str, int, int]]) -> None:
    """A member of an archive from files of deflated text, which are copied as they are: each ends on a whole byte and none refers to
    another's text, so one after the other they are one stream."""
    ends = _SHEET_ENDS.encode()
    first, last = zlib.compressobj(wbits=-15), zlib.compressobj(wbits=-15)
    packed = first.compress(begins) + first.flush(zlib.Z_FULL_FLUSH), last.compress(ends) + last.flush()
    entry = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
    entry.compress_type = zipfile.ZIP_DEFLATED
    entry.file_size, entry.CRC = len(begins), zlib.crc32(begins)
    for _, size, crc in parts:
        entry.file_size, entry.CRC = entry.file_size + size, _joined_crc(entry.CRC, crc, size)
    entry.file_size, entry.CRC = entry.file_size + len(ends), _joined_crc(entry.CRC, zlib.crc32(ends), len(ends))
    entry.compress_size = sum(map(len, packed)) + sum(files.size(path) for path, _, _ in parts)
    out = book.fp
    entry.header_offset = out.tell()
    out.write(entry.FileHeader())
    out.write(packed[0])
    for path, _, _ in parts:
        files.append(path, out)
    out.write(packed[1])
    book.start_dir = out.tell()
    book.filelist.append(entry)
    book.NameToInfo[name] = entry


def write_xlsx(path: str | Any, sheets: Mapping[str, Iterable[Sequence[Any]] | Rendered], files: Files | None = None) -> None:
    """A workbook from the standard library alone, to a local path or an open file that need not seek. Rows stream into
    the archive; a sheet that fills up goes on in another one (``name_2`` and so on). Rendered rows need ``files`` and a file of theirs."""
    names: list[str] = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for name, rows in sheets.items():
            if isinstance(rows, Rendered):
                for part, parts in enumerate(rows.sheets or [[]], 1):
                    names.append(name if part == 1 else f"{name}_{part}")
                    begins = _SHEET_BEGINS + (_row(1, rows.header) if part == 1 else "")
                    _write_rendered(book, f"xl/worksheets/sheet{len(names)}.xml", begins.encode(), files, parts)
                continue
            source, part = iter(rows), 1
            pending = next(source, None)
            while pending is not None or part == 1:
                names.append(name if part == 1 else f"{name}_{part}")
                with book.open(f"xl/worksheets/sheet{len(names)}.xml", "w") as out:
                    out.write(_SHEET_BEGINS.encode())
                    number = 0
                    while pending is not None and number < SHEET_ROWS:
                        number += 1
                        out.write(_row(number, pending).encode())
                        pending = next(source, None)
                    out.write(_SHEET_ENDS.encode())
                part += 1
        entries = "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1))
        book.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{entries}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Type="{_REL}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
        package = "http://schemas.openxmlformats.org/package/2006"
        book.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{package}/relationships">{links}</Relationships>')
        book.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(names) + 1))
        book.writestr(
            "[Content_Types].xml",
            f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>',
        )


def _cell_text(column: int, name: str, kind: T.DataType, row: Column) -> Column:
    """What :func:`_cell` makes of a field but for control characters, as an expression; ``row`` is the row's number as a text."""
    value = F.col(f"`{name}`")
    begins = F.concat(F.lit(f'<c r="{_column_name(column)}'), row)
    if isinstance(kind, T.NumericType):
        cell = F.concat(begins, F.lit('"><v>'), value.cast("string"), F.lit("</v></c>"))
    else:
        text = value.cast("string")
        for mark, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(mark), F.lit(written))
        cell = F.concat(begins, F.lit('" t="inlineStr"><is><t xml:space="preserve">'), text, F.lit("</t></is></c>"))
    return F.coalesce(cell, F.lit(""))


#: Characters that no cell may hold, a byte each.
_CONTROLS = bytes(k for k in range(32) if k not in b"\t\n\r")
_RENDERED = "sheet bigint, position bigint, path string, size bigint, crc bigint"


def _deflated(batches: Iterator[Any], folder: str) -> Iterator[Any]:
    """A partition's rendered rows (sheet, position, text) as a file a sheet, deflated. Names are an attempt's own."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    sheet = out = None
    done: list[dict[str, Any]] = []

    def close() -> None:
        out.write(packer.flush(zlib.Z_FULL_FLUSH))
        out.close()

    for batch in filter(len, batches):
        numbers = batch.column(0)
        for number in pc.unique(numbers).to_pylist():
            rows = batch.filter(pc.equal(numbers, number))
            if number != sheet:
                if out is not None:
                    close()
                sheet, packer, name = number, zlib.compressobj(wbits=-15), f"{uuid.uuid4().hex}.deflated"
                out = store.open_output_stream(f"{base}/{name}")
                done.append({"sheet": number, "position": rows.column(1)[0].as_py(), "path": f"{folder}/{name}", "size": 0, "crc": 0})
            # The texts lie one after the other in the column's buffer.
            texts = rows.column(2)
            _, offsets, data = texts.buffers()
            ends = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
            text = data[int(ends[0]) : int(ends[-1])].to_pybytes().translate(None, _CONTROLS)
            done[-1]["size"] += len(text)
            done[-1]["crc"] = zlib.crc32(text, done[-1]["crc"])
            out.write(packer.compress(text))
    if out is not None:
        close()
    if done:
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("sheet", pa.int64()), ("position", pa.int64()), ("path", pa.string()), ("size", pa.int64()), ("crc", pa.int64())]))


def _render(report: DataFrame, total: int, folder: str) -> Rendered:
    """Rows by type, table and record, rendered and deflated by tasks into ``folder``. One range sort, kept on the executors' disks: rows
    of equal keys are dealt to several partitions, whose sizes (a row each) tell the rows' numbers in the sheets."""
    if not total:
        return Rendered(report.columns)
    keys = ["Type", "Table", "Record_Index", "Data_Item", "Error_Code", "__tie"]
    limit, parts = SHEET_ROWS, -(-total // FETCHED_ROWS)
    dealt = report.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("__tie")
    dealt.persist(StorageLevel.DISK_ONLY)
    try:
        sizes = dict(dealt.groupBy(F.spark_partition_id()).count().collect())
        # The header is row 0 of the first sheet.
        starts, at = [], 1
        for part in range(max(sizes) + 1):
            starts.append(at)
            at += sizes.get(part, 0)
        begins = F.get(F.expr(f"array({', '.join(f'{start}L' for start in starts)})"), F.spark_partition_id())
        position = begins + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        placed = dealt.select("*", position.alias("__position")).select("*", (F.col("__position") % limit + 1).cast("string").alias("__row"))
        cells = [_cell_text(k, f.name, f.dataType, F.col("__row")) for k, f in enumerate(report.schema)]
        text = F.concat(F.lit('<row r="'), F.col("__row"), F.lit('">'), *cells, F.lit("</row>"))
        rows = placed.select(F.floor(F.col("__position") / limit).alias("sheet"), F.col("__position").alias("position"), text.alias("text"))
        written = rows.mapInArrow(lambda batches: _deflated(batches, folder), _RENDERED).collect()
    finally:
        dealt.unpersist()
    sheets: list[list[tuple[str, int, int]]] = [[] for _ in range(1 + (at - 1) // limit)]
    for r in sorted(written, key=lambda r: r.position):
        sheets[r.sheet].append((r.path, r.size, r.crc))
    return Rendered(report.columns, sheets)


def write_report(path: str, messages: DataFrame, tables: Sequence[str], details: Mapping[str, Any], processing_failed: bool = False) -> str:
    """Three sheets: the summary with its matrix, the aggregates, and every message. Tasks render and deflate the messages; the
    driver copies their deflated text into the workbook, a buffer at a time."""
    report = project(messages)
    counted = aggregates(report).collect()
    found = sorted({r["Type"] for r in counted})
    names = [*tables, *sorted({r["Table"] for r in counted if r["Table"]} - set(tables))]
    cells = {}
    for r in counted:
        cells[r["Type"], r["Table"]] = cells.get((r["Type"], r["Table"]), 0) + r["Count"]
    summary = [("", *pair) for pair in details.items()]
    summary += [("", "Status", verdict(found, processing_failed)), (), ("", "", *names)]
    summary += [("", kind, *(cells.get((kind, name), 0) for name in names)) for kind in found]
    columns = ["Type", "Table", "Data_Item", "Category", "Error_Code", "Count"]
    files, folder = Files(messages.sparkSession), scratch(messages.sparkSession, "workbook")
    files.make(folder)
    try:
        rendered = _render(report, sum(r["Count"] for r in counted), folder)
        with files.output(path) as out:
            write_xlsx(out, {"Summary": summary, "Error Summary": [columns, *[[r[c] for c in columns] for r in counted]], "Error Data": rendered}, files)
    finally:
        files.delete(folder)
    return verdict(found, processing_failed)
