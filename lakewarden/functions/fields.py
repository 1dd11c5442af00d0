"""Functions that a contract may apply to a field: what they make of a value, and whether they accept it."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _present(value: Column) -> Column:
    """Whether there is a value that isn't white space alone; functions make null of any other."""
    return F.coalesce(value.rlike(r"(?U)\S"), F.lit(False))


def normalise(value: Column, capitalize: bool = False) -> Column:
    """The value as it is, or with its first character in upper and the others in lower case."""
    changed = F.concat(F.upper(F.substring(value, 1, 1)), F.lower(F.substring(value, 2, (1 << 31) - 1))) if capitalize else value
    return F.when(_present(value), changed)


def exclude_word(value: Column, word: str) -> Column:
    """The value, or null if it holds the word in any case."""
    return F.when(_present(value) & ~F.contains(F.lower(value), F.lower(F.lit(word))), value)


def split(value: Column, split_on: str, keep: int = 0) -> Column:
    """One part of the value; negative positions count from the end; null if there is no such part."""
    parts = F.split(value, F.regexp_replace(F.lit(split_on), r"([\\\[\]{}()*+?.^$|])", r"\\$1"))
    return F.when(_present(value), F.try_element_at(parts, F.lit(keep + 1 if keep >= 0 else keep)))


def static_key(value: Column) -> Column:
    """1 for any value, null included: a key that joins everything."""
    return F.lit(1)


FIELD_FUNCTIONS: Mapping[str, Callable[..., Column]] = {"normalise": normalise, "exclude_word": exclude_word, "split": split, "static_key": static_key}


def accepts(value: Column, spec: Mapping[str, Any]) -> Column:
    """Whether a field function takes a value: only a part that isn't there is refused, a null result isn't."""
    if spec["name"] not in FIELD_FUNCTIONS:
        raise ValueError(f"no field function {spec['name']!r}")
    result = FIELD_FUNCTIONS[spec["name"]](value, **spec.get("kwargs", {}))
    return ~_present(value) | result.isNotNull() if spec["name"] == "split" else F.lit(True)
