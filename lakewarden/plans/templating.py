"""Templates: ``{{ expression }}`` in strings, rendered when a program is compiled or turned into a Column.

Expressions are names (``a``, ``a.b``, ``a[0]``), literals, calls of ``repr``, ``str`` and ``raise``, and the
filters ``add_months``, ``add_years`` and ``days_until``. An undefined name leaves its ``{{name}}`` in place.
"""

from __future__ import annotations

import ast
import calendar
import datetime as dt
import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_slot = re.compile(r"\{\{\s*(.*?)\s*\}\}", re.DOTALL)
_path = re.compile(r"[A-Za-z_][A-Za-z_0-9]*(?:\.[A-Za-z_][A-Za-z_0-9]*|\[\d+\])*\Z")


class TemplateError(ValueError):
    """A template that can't be rendered, or one that calls ``raise``."""


class _Undefined(Exception):
    pass


def _as_date(value: Any) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(str(value))


def add_months(value: Any, months: int) -> dt.date:
    day = _as_date(value)
    year, month = divmod(day.year * 12 + day.month - 1 + int(months), 12)
    return day.replace(year=year, month=month + 1, day=min(day.day, calendar.monthrange(year, month + 1)[1]))


def add_years(value: Any, years: int) -> dt.date:
    return add_months(value, 12 * int(years))


def days_until(value: Any, other: Any) -> int:
    return (_as_date(other) - _as_date(value)).days


FILTERS = {"add_months": add_months, "add_years": add_years, "days_until": days_until}


def _raise(message: str = "raised by template") -> None:
    raise TemplateError(message)


FUNCTIONS = {"repr": repr, "str": str, "raise": _raise}


def _evaluate(node: ast.AST, variables: Mapping[str, Any]) -> Any:
    if isinstance(node, ast.Constant):
        return node.value
    if isinstance(node, ast.Name):
        if node.id not in variables:
            raise _Undefined(node.id)
        return variables[node.id]
    if isinstance(node, ast.Attribute | ast.Subscript):
        base = _evaluate(node.value, variables)
        key = node.attr if isinstance(node, ast.Attribute) else _evaluate(node.slice, variables)
        try:
            return base[key]
        except (KeyError, IndexError, TypeError):
            raise _Undefined(ast.unparse(node)) from None
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        return -_evaluate(node.operand, variables)
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in {**FUNCTIONS, **FILTERS} and not node.keywords:
        return {**FUNCTIONS, **FILTERS}[node.func.id](*(_evaluate(a, variables) for a in node.args))
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):  # value | filter(arguments)
        call = node.right if isinstance(node.right, ast.Call) else ast.Call(node.right, [], [])
        if isinstance(call.func, ast.Name) and call.func.id in FILTERS:
            return FILTERS[call.func.id](_evaluate(node.left, variables), *(_evaluate(a, variables) for a in call.args))
    raise TemplateError(f"unsupported template expression {ast.unparse(node)!r}")


def render(value: Any, variables: Mapping[str, Any]) -> Any:
    """Render every string in ``value``, keys of mappings included."""
    if isinstance(value, str):

        def one(match: re.Match) -> str:
            source = re.sub(r"\braise\(", "_raise_(", match[1])
            try:
                tree = ast.parse(source, mode="eval").body
            except SyntaxError:
                raise TemplateError(f"can't read the template {match[0]!r}") from None
            for node in ast.walk(tree):
                if isinstance(node, ast.Name) and node.id == "_raise_":
                    node.id = "raise"
            try:
                return str(_evaluate(tree, variables))
            except _Undefined:
                return "{{" + match[1] + "}}"

        return _slot.sub(one, value)
    if isinstance(value, Mapping):
        return {render(k, variables): render(v, variables) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return type(value)(render(v, variables) for v in value)
    return value


# Templates as columns


def text_of(column: Column, kind: T.DataType, nested: bool = False) -> Column:
    """A value as a template shows it: None, True, [1, 2], {'a': 1}; strings in lists are quoted."""
    if isinstance(kind, T.StringType):
        text = F.concat(F.lit("'"), column, F.lit("'")) if nested else column
    elif isinstance(kind, T.BooleanType):
        text = F.when(column, "True").otherwise("False")
    elif isinstance(kind, T.ArrayType):
        inner = F.transform(column, lambda x: text_of(x, kind.elementType, True))
        text = F.concat(F.lit("["), F.array_join(inner, ", "), F.lit("]"))
    elif isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f"'{f.name}': "), text_of(column.getField(f.name), f.dataType, True)) for f in kind.fields]
        text = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    else:
        text = column.cast("string")
    return F.when(column.isNull(), F.lit("None")).otherwise(text)


def to_column(template: str, schema: T.StructType, extra: Mapping[str, Column] | None = None) -> Column:
    """A template over a row's columns as a string Column; ``extra`` adds string columns by name."""
    extra = dict(extra or {})
    pieces: list[Column] = []
    at = 0
    for match in _slot.finditer(template):
        pieces.append(F.lit(template[at : match.start()]))
        at = match.end()
        name = match[1]
        if name in extra:
            pieces.append(F.coalesce(extra[name], F.lit("None")))
        elif _path.match(name) and (found := _lookup(name, schema)) is not None:
            pieces.append(text_of(*found))
        else:
            pieces.append(F.lit("{{" + name + "}}"))
    pieces.append(F.lit(template[at:]))
    return F.concat(*pieces)


def _lookup(path: str, schema: T.StructType) -> tuple[Column, T.DataType] | None:
    kind: T.DataType = schema
    column: Column | None = None
    for name, index in re.findall(r"([A-Za-z_][A-Za-z_0-9]*)|\[(\d+)\]", path):
        if name:
            if not isinstance(kind, T.StructType) or name not in kind.names:
                return None
            column = F.col(f"`{name}`") if column is None else column.getField(name)
            kind = kind[name].dataType
        else:
            if not isinstance(kind, T.ArrayType):
                return None
            column, kind = F.get(column, F.lit(int(index))), kind.elementType
    return column, kind
