"""Feedback messages: one row for each issue of a record, with the columns that reports and audits read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRINGS = ("Entity", "Key", "FailureType", "Status", "ErrorType", "ErrorLocation", "ErrorMessage", "ErrorCode", "ReportingField")
MESSAGE_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in _STRINGS]
    + [T.StructField("RecordIndex", T.LongType()), T.StructField("Value", T.StringType()), T.StructField("Category", T.StringType())]
)
CATEGORIES = ("Blank", "Wrong format", "Bad value", "Bad file")
#: What a rule's severity means for a message: failure type and status.
SEVERITIES = {
    "info": ("record", "informational"),
    "warning": ("record", "informational"),
    "record_failure": ("record", "error"),
    "submission_failure": ("submission", "error"),
    "critical_failure": ("integrity", "error"),
}
#: Values of a list that a message shows at most, and what stands between them.
SHOWN, SEPARATOR = 10, " -- "


@dataclass(frozen=True, kw_only=True)
class Reporting:
    """How a filter reports: severity, texts, and which fields it shows."""

    emit: str = "record_failure"
    code: str | None = None
    message: str | None = None
    category: str = "Bad value"
    location: str | None = None
    reporting_field: str | tuple[str, ...] | None = None
    reporting_field_name: str | None = None
    reporting_entity: str | None = None

    def __post_init__(self) -> None:
        if self.emit not in SEVERITIES:
            raise ValueError(f"unknown severity {self.emit!r}")
        if self.category not in CATEGORIES:
            raise ValueError(f"unknown category {self.category!r}")
        if self.location:
            parse_location(self.location)


def severity(failure_type: str = "record", informational: bool | str = False) -> str:
    """The severity that the older pair of fields stands for."""
    if informational is True or str(informational).lower() == "true":
        return "warning"
    if failure_type in ("submission", "group"):
        return "submission_failure"
    return "critical_failure" if failure_type == "integrity" else "record_failure"


def parse_location(location: str) -> tuple[str | None, list[str] | None]:
    """Root (None: the record) and fields (None: all) of ``a``, ``a, b``, ``s.f``, ``s.{f, g}`` or ``s.*``."""
    root, dot, fields = location.partition(".")
    if "." in fields:
        raise ValueError(f"a location has one level at most: {location!r}")
    names = [name.strip() for name in (fields if dot else root).strip("{}").split(",")]
    return (root.strip() if dot else None), (None if names == ["*"] else names)


def located(location: str, frame: DataFrame) -> Column:
    """What a location selects, as a struct, or an array of structs where the root is one."""
    root, fields = parse_location(location)
    if root is None:
        return F.struct(*[F.col(f"`{name}`") for name in (fields or frame.columns)])
    kind = frame.schema[root].dataType
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
    names = fields or inner.fieldNames()
    pick = lambda x: F.struct(*[x.getField(name).alias(name) for name in names])
    return F.transform(F.col(f"`{root}`"), pick) if isinstance(kind, T.ArrayType) else pick(F.col(f"`{root}`"))


def plain_text(column: Column, kind: T.DataType) -> Column:
    """A value on its own: ISO times, decimals without trailing zeros, null stays null."""
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        whole = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.date_format(column, "SSSSSS")
        return F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))
    if isinstance(kind, T.DecimalType):
        text = column.cast("string")
        return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")).otherwise(text)
    if isinstance(kind, T.BooleanType):
        return F.when(column, "True").when(~column, "False")
    return column.cast("string")


def _list_text(values: Column, kind: T.DataType, field: str | None) -> Column:
    """Sorted, the first ``SHOWN`` of them, with a note if there are more."""
    if isinstance(kind, T.StructType) and field in kind.names:
        show = lambda x: F.coalesce(plain_text(x.getField(field), kind[field].dataType), F.lit("None"))
    else:
        show = lambda x: F.coalesce(plain_text(x, kind), F.lit("None"))
    texts = F.transform(F.slice(F.array_sort(values), 1, SHOWN), show)
    joined = F.array_join(F.filter(texts, lambda t: t != ""), SEPARATOR)
    more = F.lit(f"{SEPARATOR}only first {SHOWN} shown")
    return F.when(F.size(values) > SHOWN, F.concat(joined, more)).otherwise(joined)


def field_text(frame: DataFrame, name: str) -> Column:
    """The value of a field as a message shows it."""
    if name not in frame.columns:
        return F.lit(None).cast("string")
    kind, column = frame.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.ArrayType):
        return F.when(column.isNotNull(), _list_text(column, kind.elementType, name))
    if isinstance(kind, T.StructType):
        return plain_text(column.getField(name), kind[name].dataType) if name in kind.names else F.lit(None).cast("string")
    return plain_text(column, kind)


def value_column(reporting: Reporting, frame: DataFrame) -> Column:
    """The value that the reporting fields (or else the location) show; several as sorted ``field=value`` pairs."""
    fields = reporting.reporting_field
    if fields is None and reporting.location:
        root, names = parse_location(reporting.location)
        if root is not None:
            kind = frame.schema[root].dataType if root in frame.columns else None
            if isinstance(kind, T.StructType) and names and len(names) == 1 and names[0] in kind.names:
                return plain_text(F.col(f"`{root}`.`{names[0]}`"), kind[names[0]].dataType)
            return F.to_json(located(reporting.location, frame)) if kind is not None else F.lit(None).cast("string")
        fields = tuple(names) if names and len(names) > 1 else (names[0] if names else None)
    if fields is None:
        return F.lit(None).cast("string")
    if isinstance(fields, str):
        return field_text(frame, fields)
    pairs = [F.concat(F.lit(f"{name}="), F.coalesce(field_text(frame, name), F.lit("None"))) for name in fields]
    return F.array_join(F.array_sort(F.array(*pairs)), ", ")


def key_column(frame: DataFrame, fields: Sequence[str]) -> Column:
    """``field: value -- field: value``; empty without key fields."""
    known = [name for name in fields if name in frame.columns]
    if not known:
        return F.lit("")
    parts = [F.concat(F.lit(f"{name}: "), F.coalesce(plain_text(F.col(f"`{name}`"), frame.schema[name].dataType), F.lit("None"))) for name in known]
    return F.concat_ws(SEPARATOR, *parts)


def message_struct(reporting: Reporting, *, entity: str, key: Column, error_type: str, message: Column, index: Column, value: Column, position: int = 0) -> Column:
    """One message as a struct with the columns of ``MESSAGE_SCHEMA``."""
    failure, status = SEVERITIES[reporting.emit]
    field = reporting.reporting_field
    shown = reporting.reporting_field_name or (", ".join(field) if isinstance(field, tuple) else field) or reporting.location
    literal = lambda x: F.lit(x).cast("string")
    values = [
        literal(reporting.reporting_entity or entity), key, literal(failure), literal(status), literal(error_type), literal(reporting.location),
        message, literal(reporting.code), literal(shown), index.cast("long"), value, literal(reporting.category),
    ]
    return F.struct(*[v.alias(f.name) for v, f in zip(values, MESSAGE_SCHEMA, strict=True)])


def submission_message(spark: Any, code: str, text: str, *, entity: str | None = None, value: str | None = None, category: str = "Bad file") -> DataFrame:
    """A message about a whole submission, such as a header that doesn't fit."""
    row = (entity, "", "submission", "error", "reader", "Whole File", text, code, None, None, value, category)
    return spark.createDataFrame([row], MESSAGE_SCHEMA)


def distinct_messages(frame: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Messages without repeats, for those about files: one file read for several entities says the same each time. With
    columns that order them each stands where it first occurs (one aggregation and a range sort), and they are kept."""
    if not order:
        return frame.distinct()
    columns = [c for c in frame.columns if c not in order]
    first = F.min(F.struct(*order)).alias("__first")
    once = frame.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(first).orderBy("__first")
    return once.select(*[F.col(f"__first.`{c}`") if c in order else F.col(f"`{c}`") for c in frame.columns])


def messages_from(frame: DataFrame, **columns: Column) -> DataFrame:
    """One message for each row of a frame: columns of messages by expressions, null where there is none."""
    unknown = sorted(set(columns) - set(MESSAGE_SCHEMA.names))
    if unknown:
        raise ValueError(f"messages have no column {', '.join(unknown)}")
    return frame.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in MESSAGE_SCHEMA])


def submission_messages(frame: DataFrame, code: Column, text: Column, *, entity: Column | None = None, value: Column | None = None, category: str = "Bad file") -> DataFrame:
    """What :func:`submission_message` says, for each row of a frame, such as a list of refused files."""
    fixed = {"Key": "", "FailureType": "submission", "Status": "error", "ErrorType": "reader", "ErrorLocation": "Whole File", "Category": category}
    given = {"ErrorCode": code, "ErrorMessage": text, "Entity": entity, "Value": value}
    return messages_from(frame, **{k: F.lit(v) for k, v in fixed.items()}, **{k: v for k, v in given.items() if v is not None})


def from_mapping(spark: Any, rows: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Messages from dictionaries with some of the columns."""
    return spark.createDataFrame([tuple(r.get(f.name) for f in MESSAGE_SCHEMA) for r in rows], MESSAGE_SCHEMA)
