"""SQL expression text: splitting, aliases, null-safe boolean reducers, literals from Python values."""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A list of expressions, a comma-separated string of them, or expression -> alias (several for a generator).
Expressions = str | Sequence[str] | Mapping[str, str | Sequence[str]]

_CLOSERS = {")": "(", "]": "[", "}": "{"}


def split_expressions(text: str) -> list[str]:
    """Cut at commas that are outside brackets and quotes. Unbalanced text is an error."""
    parts, start, stack, quote, skip = [], 0, [], "", False
    for at, char in enumerate(text):
        if skip:
            skip = False
        elif quote:
            if char == "\\" and quote != "`":
                skip = True
            elif char == quote:
                quote = ""
        elif char in "'\"`":
            quote = char
        elif char in _CLOSERS.values():
            stack.append(char)
        elif char in _CLOSERS:
            if not stack or stack.pop() != _CLOSERS[char]:
                raise ValueError(f"unbalanced {char!r} in expression list: {text!r}")
        elif char == "," and not stack:
            parts.append(text[start:at])
            start = at + 1
    if quote or stack:
        raise ValueError(f"unfinished {quote or stack[-1]!r} in expression list: {text!r}")
    parts.append(text[start:])
    return [part.strip() for part in parts if part.strip()]


def to_columns(expressions: Expressions) -> list[Column]:
    if isinstance(expressions, str):
        return [F.expr(e) for e in split_expressions(expressions)]
    if isinstance(expressions, Mapping):
        columns = []
        for text, alias in expressions.items():
            names = [alias] if isinstance(alias, str) else list(alias)
            columns.append(F.expr(text).alias(*names))
        return columns
    return [F.expr(e) for e in expressions]


def _holds(column: Column) -> Column:
    return F.coalesce(column, F.lit(False))


def all_of(columns: Iterable[Column]) -> Column:
    """AND with null as false; true for none."""
    return reduce(lambda a, b: a & b, map(_holds, columns), F.lit(True))


def any_of(columns: Iterable[Column]) -> Column:
    """OR with null as false; false for none."""
    return reduce(lambda a, b: a | b, map(_holds, columns), F.lit(False))


def literal(value: Any) -> Column:
    """A literal of a scalar, a dict (struct) or a list (array of one type)."""
    if isinstance(value, Mapping):
        return F.struct(*[literal(v).alias(k) for k, v in value.items()])
    if isinstance(value, list | tuple):
        kinds = {type(v) for v in value if v is not None}
        if len(kinds) > 1:
            raise ValueError(f"a list literal needs one type, not {sorted(k.__name__ for k in kinds)}")
        return F.array(*map(literal, value))
    if value is None or isinstance(value, str | bool | int | float | bytes | decimal.Decimal | dt.date | dt.datetime):
        return F.lit(value)
    raise ValueError(f"no literal for {type(value).__name__}")


def quoted(name: str) -> str:
    """A column name with every dotted segment quoted."""
    return ".".join(f"`{segment.replace('`', '``')}`" for segment in name.split("."))
