"""The data contract compiled to Catalyst: one projection gives the typed columns and the issues of each record.

An issue is a struct with the columns of a message. ``messages`` explodes them, ``typed`` leaves them out; both read
the same flagged plan, which a caller may stage. Nothing here runs Python for a row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.functions.fields import accepts
from lakewarden.operators.catalog import RECORD_INDEX
from lakewarden.plans.config import Contract, FieldSpec, SchemaSpec
from lakewarden.plans.messages import MESSAGE_SCHEMA, Reporting, key_column, message_struct
from lakewarden.plans.templating import to_column
from lakewarden.plans.types import rule_for

ISSUES = "__issues__"
ERROR_VALUE = "__error_value"
#: Codes and texts where the contract gives none.
DEFAULTS = {
    "Blank": {"error_code": "FieldBlank", "error_message": "cannot be blank"},
    "Bad value": {"error_code": "BadValue", "error_message": "is invalid"},
    "Wrong format": {"error_code": "WrongFormat", "error_message": "has wrong format"},
}
_LEVELS = {"record": "record_failure", "submission": "submission_failure", "integrity": "critical_failure"}


@dataclass(frozen=True)
class ContractOutcome:
    typed: DataFrame
    messages: DataFrame
    flagged: DataFrame


class _Compiler:
    def __init__(self, contract: Contract, entity: str, frame: DataFrame, keys: Sequence[str]):
        self.contract, self.entity, self.frame = contract, entity, frame
        self.key = key_column(frame, keys)
        self.index = F.col(RECORD_INDEX) if RECORD_INDEX in frame.columns else F.lit(None)

    def issue(self, path: tuple[str, ...], location: Column, category: str, error_type: str, value: Column, *, warning: Column | None = None) -> Column:
        detail = self.contract.error_details.get(".".join(path), {}).get(category) or DEFAULTS[category]
        emit = "warning" if warning is not None or detail.get("is_informational") else _LEVELS[detail.get("error_level") or "record"]
        text = warning if warning is not None else to_column(detail.get("error_message") or "", self.frame.schema, {ERROR_VALUE: value})
        reporting = Reporting(emit=emit, code=detail["error_code"], category=category, reporting_field=path[-1], reporting_entity=detail.get("reporting_entity"))
        row = message_struct(reporting, entity=self.entity, key=self.key, error_type=error_type, message=text, index=self.index, value=value)
        return row.withField("ErrorLocation", location)

    def field(self, spec: FieldSpec, raw: Column, path: tuple[str, ...], location: Column, mandatory: bool) -> tuple[Column, list[Column]]:
        """The typed column and the issue structs (null where there is none), arrays of them included."""
        blank = F.when(raw.isNull(), self.issue(path, location, "Blank", "missing", F.lit(None).cast("string"))) if mandatory else None
        found = [F.array(blank)] if blank is not None else []
        if spec.is_array:
            one = FieldSpec(spec.kind, spec.model, spec.arguments, False, spec.functions)
            typed = F.transform(raw, lambda x: self.field(one, x, path, location, False)[0])
            inner = F.transform(raw, lambda x, i: F.flatten(F.array(*self.field(one, x, path, F.concat(location, F.lit(", "), i.cast("string")), True)[1])))
            return typed, [*found, F.coalesce(F.flatten(inner), _no_issues())]
        if spec.model is not None:
            typed, inner = self.struct(self.contract.schemas[spec.model], raw, path, location)
            return F.when(raw.isNotNull(), typed), [*found, F.when(raw.isNotNull(), F.flatten(F.array(*inner))).otherwise(_no_issues()) if inner else _no_issues()]
        rule = rule_for(spec.kind, spec.arguments)
        text = raw.cast("string")
        good = F.coalesce(rule.valid(text), F.lit(False))
        problems = [F.when(text.isNotNull() & ~good, self.issue(path, location, "Bad value", rule.error_type, text))]
        if rule.warning is not None:
            noted = rule.warning(text)
            problems.append(F.when(good & noted.isNotNull(), self.issue(path, location, "Wrong format", "warning", text, warning=noted)))
        for function in spec.functions:
            problems.append(F.when(good & ~F.coalesce(accepts(text, function), F.lit(False)), self._refused(function, path, location, text)))
        return rule.cast(text).cast(rule.data_type), [*found, F.array(*problems)]

    def _refused(self, function: Mapping[str, Any], path: tuple[str, ...], location: Column, text: Column) -> Column:
        message = F.lit(function.get("error_message") or f"{function['name']} failed")
        level = function.get("error_type", "record_rejection")
        if level == "warning":
            return self.issue(path, location, "Wrong format", function["name"], text, warning=message)
        row = self.issue(path, location, "Bad value", function["name"], text).withField("ErrorMessage", message)
        return row.withField("FailureType", F.lit("submission" if level == "file_rejection" else "record"))

    def struct(self, schema: SchemaSpec, raw: Column | None, path: tuple[str, ...], location: Column | None) -> tuple[Column, list[Column]]:
        columns, issues = [], []
        for name, spec in schema.fields.items():
            column = F.col(f"`{name}`") if raw is None else raw.getField(name)
            if raw is None and name not in self.frame.columns:
                column = F.lit(None).cast(self._raw_type(spec))
            at = F.lit(name) if location is None else F.concat(location, F.lit(f", {name}"))
            typed, found = self.field(spec, column, (*path, name), at, name in schema.mandatory)
            columns.append(typed.alias(name))
            issues += found
        return F.struct(*columns), issues

    def _raw_type(self, spec: FieldSpec) -> T.DataType:
        return raw_type(self.contract, spec)


def _no_issues() -> Column:
    return F.array().cast(T.ArrayType(MESSAGE_SCHEMA))


def raw_type(contract: Contract, spec: FieldSpec) -> T.DataType:
    """The type that readers give a field: strings in the containers of the contract."""
    kind: T.DataType = raw_schema(contract, contract.schemas[spec.model]) if spec.model is not None else T.StringType()
    return T.ArrayType(kind) if spec.is_array else kind


def raw_schema(contract: Contract, schema: SchemaSpec) -> T.StructType:
    return T.StructType([T.StructField(name, raw_type(contract, spec)) for name, spec in schema.fields.items()])


def apply_contract(contract: Contract, entity: str, frame: DataFrame, hold=None) -> ContractOutcome:
    """Type and validate an entity. Columns that the contract doesn't know are left out; missing ones are null."""
    dataset = contract.datasets[entity]
    frame = _as_declared(contract, dataset, frame)
    compiler = _Compiler(contract, entity, frame, dataset.reporting_fields)
    packed, issues = compiler.struct(dataset, None, (), None)
    index = [RECORD_INDEX] if RECORD_INDEX in frame.columns else []
    flat = F.flatten(F.array(*issues)) if issues else _no_issues()
    flagged = frame.select(packed.alias("__typed__"), *index, F.array_compact(flat).alias(ISSUES))
    if hold is not None:
        flagged = hold(flagged)
    typed = flagged.select("__typed__.*", *index)
    messages = flagged.select(F.explode(ISSUES).alias("m")).select("m.*")
    return ContractOutcome(typed, messages, flagged)


def _as_declared(contract: Contract, dataset: SchemaSpec, frame: DataFrame) -> DataFrame:
    """Columns by their contract names (in any case), with nested fields that the input lacks added as null."""
    actual = {c.lower(): c for c in frame.columns}
    columns = []
    for name, spec in dataset.fields.items():
        if name.lower() in actual:
            column = F.col(f"`{actual[name.lower()]}`")
            wanted, have = raw_type(contract, spec), frame.schema[actual[name.lower()]].dataType
            columns.append((column if have == wanted else _reshaped(column, have, wanted)).alias(name))
    if RECORD_INDEX in frame.columns:
        columns.append(F.col(RECORD_INDEX))
    return frame.select(*columns)


def _reshaped(column: Column, have: T.DataType, wanted: T.DataType) -> Column:
    if isinstance(wanted, T.ArrayType):
        if not isinstance(have, T.ArrayType):  # a single element that a reader did not wrap
            return F.when(column.isNotNull(), F.array(_reshaped(column, have, wanted.elementType)))
        return F.transform(column, lambda x: _reshaped(x, have.elementType, wanted.elementType))
    if isinstance(wanted, T.StructType) and isinstance(have, T.StructType):
        names = {n.lower(): n for n in have.names}
        parts = [
            (_reshaped(column.getField(names[f.name.lower()]), have[names[f.name.lower()]].dataType, f.dataType) if f.name.lower() in names else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in wanted.fields
        ]
        return F.when(column.isNotNull(), F.struct(*parts))
    return column.cast(wanted)


def reject_records(typed: DataFrame, messages: DataFrame, entity: str) -> DataFrame:
    """Rows without a record-level error of this entity. Indices of rejected rows are joined, never collected."""
    rejected = messages.where((F.col("FailureType") == "record") & (F.col("Status") != "informational") & (F.col("Entity") == entity))
    return typed.join(rejected.select(F.col("RecordIndex").alias(RECORD_INDEX)).distinct(), RECORD_INDEX, "left_anti")
