"""Readers: CSV, JSON, XML and Parquet to entities whose leaves are strings.

Every reader is native to Spark and lazy; only the guards look at the head of a file. Readers are registered by name
and chosen by file extension in the contract.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.operators.index import add_record_index
from lakewarden.sources.files import Files
from lakewarden.sources.splitting import CsvScanner, JsonScanner, Records, XmlScanner

HEAD_BYTES = 4096
CORRUPT = "_corrupt_record"
NULL_TOKENS = ("NULL", "null", "")


class ReaderError(ValueError):
    """A file can't be read as what it should be."""


class EmptyFileError(ReaderError):
    pass


#: Options that documents may hold for readers of other kinds and that mean nothing here.
IGNORED_OPTIONS = {"spark_session", "connection", "rules_location", "json_format"}


def _refuse_unknown(reader: str, options: Mapping[str, Any]) -> None:
    unknown = sorted(set(options) - IGNORED_OPTIONS)
    if unknown:
        raise ReaderError(f"the {reader} reader has no option {', '.join(unknown)}")


def charset(encoding: str) -> str:
    """The name that Java knows a character set by; a byte order mark is skipped in any case."""
    return "utf-8" if encoding.lower() in ("utf-8-sig", "utf8", "utf_8_sig") else encoding


@dataclass
class SubmissionRejected(ReaderError):
    """The file as a whole is refused; becomes a submission message."""

    code: str
    text: str
    value: str | None = None

    def __str__(self) -> str:
        return f"{self.code}: {self.text}"


Reader = Callable[..., DataFrame]
_readers: dict[str, Reader] = {}


def register_reader(name: str) -> Callable[[Reader], Reader]:
    def add(reader: Reader) -> Reader:
        _readers[name] = reader
        return reader

    return add


def get_reader(name: str) -> Reader:
    if name not in _readers:
        raise ReaderError(f"no reader {name!r}; there are {sorted(_readers)}")
    return _readers[name]


# Guards


def head_of(spark: SparkSession, path: str, size: int = HEAD_BYTES) -> bytes:
    """The first bytes of a file (of the first file of a folder), through Spark's file systems."""
    return Files(spark).head(path, size)


def guard(spark: SparkSession, path: str) -> bytes:
    """Refuse empty files and files with null bytes (unless they are UTF-16); returns the head."""
    head = head_of(spark, path)
    if not head:
        raise EmptyFileError(f"{path} is empty")
    if b"\x00" in head and not head.startswith((b"\xff\xfe", b"\xfe\xff")):
        raise SubmissionRejected("MalformedFile", "file contains null bytes and can't be read as text")
    return head


def compare_header(found: Sequence[str], expected: Sequence[str], code: str = "FieldCountMismatch", message: str | None = None) -> None:
    """Refuse a header that lacks fields or has others, in any case of letters."""
    have, want = {c.lower() for c in found}, {c.lower() for c in expected}
    missing, additional = sorted(c for c in expected if c.lower() not in have), sorted(c for c in found if c.lower() not in want)
    if missing or additional:
        parts = [f"{label} fields: {', '.join(names)}" for label, names in (("Missing", missing), ("Additional", additional)) if names]
        raise SubmissionRejected(code, message or "The submitted header is missing fields or has additional ones", "; ".join(parts))


# Shaping


def blank_to_null(column: Column, tokens: Sequence[str] = NULL_TOKENS, trim: bool = True) -> Column:
    text = F.trim(column) if trim else column
    return F.when(~text.isin(*tokens), text)


def one_line(column: Column) -> Column:
    """Line breaks with the white space around them as one space."""
    return F.regexp_replace(column, r"\s*\n\s*", " ")


def _clean_strings(frame: DataFrame, clean: Callable[[Column], Column]) -> DataFrame:
    columns = {f.name: clean(F.col(f"`{f.name}`")) for f in frame.schema if isinstance(f.dataType, T.StringType)}
    return frame.withColumns(columns) if columns else frame


def stringified(frame: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """Every leaf as a string; with a schema, its columns in its order, missing ones as null."""

    def as_text(kind: T.DataType) -> T.DataType:
        if isinstance(kind, T.StructType):
            return T.StructType([T.StructField(f.name, as_text(f.dataType)) for f in kind])
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(as_text(kind.elementType))
        return T.StringType()

    if schema is None:
        return frame.select(*[F.col(f"`{f.name}`").cast(as_text(f.dataType)).alias(f.name) for f in frame.schema])
    have = {c.lower(): c for c in frame.columns}
    return frame.select(
        *[(F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)).cast(as_text(f.dataType)).alias(f.name) for f in schema]
    )


# Readers


def _csv_options(options: Mapping[str, Any]) -> dict[str, Any]:
    names = {"delimiter": "sep", "delim": "sep", "quote_char": "quote", "quotechar": "quote", "escape_char": "escape", "encoding": "encoding"}
    _refuse_unknown("CSV", {k: v for k, v in options.items() if k not in names})
    return {names[k]: charset(v) if k == "encoding" else v for k, v in options.items() if k in names and v is not None}


def _header_line(spark: SparkSession, path: str, options: Mapping[str, Any]) -> list[str]:
    """The cells of the first line, as far as the head of the file has it."""
    first = head_of(spark, path).decode(options.get("encoding") or "utf-8", errors="replace").splitlines()[:1]
    return first[0].split(options.get("delimiter") or options.get("delim") or ",") if first else []


@register_reader("csv")
def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, *, header: bool = True, multi_line: bool = False, trim_cells: bool = True,
    null_values: Sequence[str] = NULL_TOKENS, null_empty_strings: bool = False, field_check: bool = False,
    field_check_error_code: str = "FieldCountMismatch", field_check_error_message: str | None = None, **options: Any,
) -> DataFrame:
    """Columns are found by the header in any case; missing ones are null, others are not read. Without a header the
    number of fields must fit."""
    if any(not isinstance(f.dataType, T.StringType) for f in schema):
        raise ReaderError("a CSV file can't hold nested fields")
    guard(spark, path)
    reader = spark.read.options(header=header, multiLine=multi_line, inferSchema=False, enforceSchema=False, nullValue="\x01", emptyValue="", **_csv_options(options))
    try:
        raw = reader.csv(path)
    except Exception as error:
        code, text = field_check_error_code, field_check_error_message or "The file can't be read as CSV"
        raise SubmissionRejected(code, text, "Unable to parse file. Please check the structure of the file.") from error
    if header and not any(c.strip().strip("\ufeff") for c in _header_line(spark, path, options)):
        raise SubmissionRejected(field_check_error_code, field_check_error_message or "The file can't be read as CSV", "Unable to parse file. Please check the structure of the file.")
    if header:
        names = [c.strip().strip("﻿") for c in raw.columns]
        if field_check:
            compare_header(names, schema.names, field_check_error_code, field_check_error_message)
        raw = raw.toDF(*names)
    else:
        if len(raw.columns) != len(schema):
            raise SubmissionRejected("FieldCountMismatch", f"expected {len(schema)} fields and found {len(raw.columns)}")
        raw = raw.toDF(*schema.names)
    if multi_line and _splits(options.get("encoding") or "utf-8"):
        raw = _split_csv(spark, path, raw.columns, header, _csv_options(options))
    shaped = stringified(raw, schema)
    tokens = ("",) if null_empty_strings else tuple(null_values)
    return _clean_strings(shaped, lambda c: blank_to_null(c, tokens, trim_cells or null_empty_strings))


def _splits(encoding: str) -> bool:
    """Whether records can be cut out of bytes as they are."""
    return charset(encoding).lower() in ("utf-8", "us-ascii", "ascii")


def _split_csv(spark: SparkSession, path: str, names: Sequence[str], header: bool, options: Mapping[str, Any]) -> DataFrame:
    """The records of files whose quoted cells may hold line breaks, read by as many tasks as there are splits."""
    marks = {"delimiter": options.get("sep", ","), "quote": options.get("quote", '"'), "escape": options.get("escape", "\\")}
    found = Records(spark, path, lambda mode, depth: CsvScanner(mode, depth, **marks)).frame()
    text = F.regexp_replace(F.regexp_replace("text", r"\r?\n\z", ""), "^\ufeff", "")
    found = found.select("file", "block", "number", text.alias("text")).where(F.trim("text") != "")
    if header:
        found = found.where("NOT (block = 0 AND number = 1)")
    ddl = ", ".join(f"`{k}` string" for k in range(len(names)))
    given = {k: str(v) for k, v in options.items() if k != "encoding"}
    cells = F.from_csv("text", ddl, {"nullValue": "\x01", "emptyValue": "", "lineSep": "\x02", "maxCharsPerColumn": "-1", **given})
    return found.select(cells.alias("cells")).select("cells.*").toDF(*names)


@register_reader("repeating_header_csv")
def read_repeating_header(
    spark: SparkSession, path: str, schema: T.StructType, *, non_unique_header_error_code: str = "NonUniqueHeader",
    non_unique_header_error_message: str | None = None, **options: Any,
) -> DataFrame:
    """One row of columns that repeat on every line; several different ones reject the submission."""
    distinct = read_csv(spark, path, schema, **options).distinct()
    rows = distinct.limit(SHOWN_HEADERS + 1).collect()
    if len(rows) > 1:
        differing = [f"{name}: {', '.join(sorted({str(r[name]) for r in rows}))}" for name in schema.names if len({r[name] for r in rows}) > 1]
        raise SubmissionRejected(non_unique_header_error_code, non_unique_header_error_message or "The header values are not the same on every line", "; ".join(differing))
    return distinct


#: Different headers that a message lists at most.
SHOWN_HEADERS = 10


@register_reader("json")
def read_json(spark: SparkSession, path: str, schema: T.StructType, *, multi_line: bool = True, encoding: str = "utf-8", **options: Any) -> DataFrame:
    _refuse_unknown("JSON", options)
    head = guard(spark, path)
    if multi_line and _splits(encoding) and head.removeprefix(b"\xef\xbb\xbf").lstrip().startswith(b"["):
        found = Records(spark, path, JsonScanner).frame()
        return found.select(F.from_json("text", schema).alias("record")).select("record.*")
    return spark.read.schema(schema).json(path, multiLine=multi_line, encoding=charset(encoding))


@register_reader("xml")
def read_xml(
    spark: SparkSession, path: str, schema: T.StructType, *, record_tag: str, root_tag: str | None = None, trim_cells: bool = True,
    null_values: Sequence[str] = NULL_TOKENS, sanitise_multiline: bool = True, n_records_to_read: int | None = None,
    xsd_location: str | None = None, xsd_error_code: str = "XSDValidationError", xsd_error_message: str | None = None,
    encoding: str = "utf-8", exclude_attribute: bool = True, ignore_namespace: bool = True, namespace: str | None = None,
    mode: str = "PERMISSIVE", infer_schema: bool = False, sampling_ratio: float = 1.0, **options: Any,
) -> DataFrame:
    """Records are the elements of ``record_tag``, under any namespace prefix or that of ``namespace``.

    With ``root_tag`` they are the children of such elements only. Where that is the document's own root all records are
    below it, so each is a row from the start; otherwise a row is one ``root_tag`` element, whose records are exploded.
    ``infer_schema`` reads what is there (from a share of ``sampling_ratio``) and fits it to the schema afterwards, so that
    a single element and a list of them are both lists. Of a file that ends too early the whole rows are read: an element
    that nothing closes is none.
    """
    _refuse_unknown("XML", options)
    if mode not in ("PERMISSIVE", "DROPMALFORMED", "FAILFAST"):
        raise ReaderError(f"the XML reader has no mode {mode!r}")
    head = guard(spark, path).decode(encoding, errors="replace")
    if xsd_location:
        _validate_xsd(spark, path, xsd_location, xsd_error_code, xsd_error_message)
    root = _root_of(head)
    inner = root_tag is not None and root_tag != root.split(":")[-1] and root_tag != root
    tag = root_tag if inner else record_tag
    by_prefix = namespace is not None or not ignore_namespace
    reader = spark.read.format("xml").options(
        rowTag=f"{namespace}:{tag}" if namespace else tag, ignoreNamespace=not by_prefix, excludeAttribute=exclude_attribute, charset=charset(encoding),
        nullValue="", mode=mode, samplingRatio=sampling_ratio, inferSchema=False, columnNameOfCorruptRecord=CORRUPT,
    )
    inside = T.StructType([T.StructField(f"{namespace}:{record_tag}" if namespace else record_tag, T.ArrayType(schema))]) if inner else schema
    if infer_schema:
        frame = reader.load(path)
    else:
        wanted = _prefixed(inside, namespace) if namespace else inside
        wanted = T.StructType([*wanted, T.StructField(CORRUPT, T.StringType())])
        if _splits(encoding):
            # Elements are cut out by as many tasks as the file has splits; each is then read like a document of one row.
            found = Records(spark, path, lambda at, depth: XmlScanner(at, depth, tag=f"{namespace}:{tag}" if namespace else tag, any_prefix=not by_prefix)).frame()
            kept = {"ignoreNamespace": str(not by_prefix), "excludeAttribute": str(exclude_attribute), "nullValue": "", "columnNameOfCorruptRecord": CORRUPT}
            parsed = F.from_xml("text", wanted, {**kept, "mode": "FAILFAST" if mode == "FAILFAST" else "PERMISSIVE"})
            frame = found.select(parsed.alias("record")).select("record.*")
            frame = frame.where(F.col(CORRUPT).isNull()) if mode == "DROPMALFORMED" else frame
        else:
            frame = reader.schema(wanted).load(path)
    if CORRUPT in frame.columns:
        closed = F.col(CORRUPT).rlike(rf"</([\w.-]+:)?{tag}\s*>\s*$")
        # Spark refuses a scan of nothing but the text of corrupt rows, so the test names another column too.
        other = F.length(F.concat(F.coalesce(F.col(CORRUPT), F.lit("")), F.isnull(F.col(f"`{frame.columns[0]}`")).cast("string"))) > 0
        frame = frame.where((F.col(CORRUPT).isNull() | closed) & other).drop(CORRUPT)
    if namespace:
        frame = frame.select(*[F.col(f"`{f.name}`").cast(_plain(f.dataType, namespace)).alias(_local_name(f.name, namespace)) for f in frame.schema])
    if inner:
        held = next((f for f in frame.schema if f.name.lower() == record_tag.lower()), None)
        if held is None:
            frame = spark.createDataFrame([], schema)
        else:
            several = F.col(f"`{held.name}`") if isinstance(held.dataType, T.ArrayType) else F.array(F.col(f"`{held.name}`"))
            frame = frame.select(F.explode(several).alias("record")).where("record IS NOT NULL").select("record.*")
    if infer_schema:
        frame = fitted(frame, schema)
    if n_records_to_read is not None:
        frame = frame.limit(n_records_to_read)
    clean = lambda c: blank_to_null(one_line(c) if sanitise_multiline else c, null_values, trim_cells)
    return _clean_strings(frame, clean)


def _root_of(head: str) -> str:
    """The name of a document's first element, with its prefix."""
    import re

    found = re.search(r"<([A-Za-z_][\w.:-]*)", re.sub(r"<!--.*?-->|<[?!][^>]*>", "", head, flags=re.DOTALL))
    if found is None:
        raise ReaderError("the file has no element")
    return found[1]


def _local_name(name: str, namespace: str) -> str:
    return name.removeprefix(f"{namespace}:")


def _prefixed(kind: T.DataType, namespace: str) -> T.DataType:
    """The type with its field names under a prefix, as they stand in the file."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name if f.name.startswith(("_", f"{namespace}:")) else f"{namespace}:{f.name}", _prefixed(f.dataType, namespace)) for f in kind])
    return T.ArrayType(_prefixed(kind.elementType, namespace)) if isinstance(kind, T.ArrayType) else kind


def _plain(kind: T.DataType, namespace: str) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(_local_name(f.name, namespace), _plain(f.dataType, namespace)) for f in kind])
    return T.ArrayType(_plain(kind.elementType, namespace)) if isinstance(kind, T.ArrayType) else kind


def fitted(frame: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of any shape in that of a schema, at every depth: strings, single elements in lists, missing fields null."""

    def fit(column: Column, have: T.DataType, want: T.DataType) -> Column:
        if isinstance(want, T.ArrayType):
            if not isinstance(have, T.ArrayType):
                return F.when(column.isNotNull(), F.array(fit(column, have, want.elementType)))
            return F.transform(column, lambda x: fit(x, have.elementType, want.elementType))
        if isinstance(want, T.StructType):
            if not isinstance(have, T.StructType):
                return F.lit(None).cast(want)
            return F.when(column.isNotNull(), F.struct(*[field(lambda name: column.getField(name), have, f) for f in want]))
        if isinstance(have, T.StructType):  # an element with attributes keeps its text apart
            return column.getField("_VALUE").cast("string") if "_VALUE" in have.names else F.lit(None).cast("string")
        return column.cast("string")

    def field(get: Callable[[str], Column], have: T.StructType, want: T.StructField) -> Column:
        found = next((f for f in have if f.name.lower() == want.name.lower()), None)
        return (F.lit(None).cast(want.dataType) if found is None else fit(get(found.name), found.dataType, want.dataType)).alias(want.name)

    return frame.select(*[field(lambda name: F.col(f"`{name}`"), frame.schema, f) for f in schema])


def _validate_xsd(spark: SparkSession, path: str, xsd: str, code: str, message: str | None) -> None:
    """The file streams through the JVM's validator, which holds no more of it than the open elements. Entities and
    schemas elsewhere are not fetched."""
    jvm, files = spark.sparkContext._jvm, Files(spark)
    constants = jvm.javax.xml.XMLConstants
    factory = jvm.javax.xml.validation.SchemaFactory.newInstance(constants.W3C_XML_SCHEMA_NS_URI)
    source = jvm.javax.xml.transform.stream.StreamSource
    schema, data = files.input(xsd), files.input(path)
    try:
        validator = factory.newSchema(source(schema)).newValidator()
        for name in (constants.ACCESS_EXTERNAL_DTD, constants.ACCESS_EXTERNAL_SCHEMA):
            validator.setProperty(name, "")
        validator.validate(source(data))
    except Exception as error:
        reason = getattr(error, "java_exception", None)
        if reason is None or "SAX" not in reason.getClass().getName():
            raise
        raise SubmissionRejected(code, message or "The file does not fit its schema definition", str(reason.getMessage())[:500]) from error
    finally:
        schema.close()
        data.close()


@register_reader("parquet")
def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None, **_: Any) -> DataFrame:
    return stringified(spark.read.parquet(path), schema)


# Names that dataset documents use for these readers.
ALIASES = {
    "CSVFileReader": "csv", "SparkCSVReader": "csv", "DuckDBCSVReader": "csv", "PolarsToDuckDBCSVReader": "csv",
    "DuckDBCSVRepeatingHeaderReader": "repeating_header_csv", "SparkJSONReader": "json", "DuckDBJSONReader": "json",
    "BasicXMLFileReader": "xml", "XMLStreamReader": "xml", "SparkXMLReader": "xml", "SparkXMLStreamReader": "xml",
    "DuckDBXMLStreamReader": "xml",
}
for _alias, _name in ALIASES.items():
    _readers[_alias] = _readers[_name]


def from_rows(spark: SparkSession, rows: Sequence[Mapping[str, Any]], schema: T.StructType) -> DataFrame:
    """An entity from dictionaries."""
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def from_iterators(shards: DataFrame, rows: Callable[[Any], Iterable[Mapping[str, Any]]], schema: T.StructType, batch_rows: int = 1000) -> DataFrame:
    """An entity from Python iterators that tasks run: ``rows`` is called with each row of ``shards`` (a file's name, a range of
    keys) and yields dictionaries; missing fields are null. Neither the shards nor their rows pass through the driver,
    and a task holds ``batch_rows`` rows at a time. ``rows`` must yield the same again when a task is repeated."""
    names, columns = schema.fieldNames(), shards.columns

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import itertools

        import pandas as pd

        shape = T.Row(*columns)
        for batch in batches:
            for values in batch.itertuples(index=False, name=None):
                found = iter(rows(shape(*values)))
                while held := list(itertools.islice(found, batch_rows)):
                    yield pd.DataFrame([[r.get(n) for n in names] for r in held], columns=names, dtype=object)

    return shards.mapInPandas(run, schema)


def read_entity(spark: SparkSession, path: str, schema: T.StructType, config: Mapping[str, Any]) -> DataFrame:
    """Read by a reader configuration: ``reader`` and its ``kwargs_`` (or ``parameters``)."""
    options = {**config.get("parameters", {}), **config.get("kwargs_", {})}
    return get_reader(config["reader"])(spark, path, schema, **options)


def indexed(frame: DataFrame) -> DataFrame:
    return add_record_index(frame)
