"""The catalog that steps read and extend: entity names to lazily planned DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

#: Entities under this prefix are read-only reference data.
REFERENCE_PREFIX = "refdata_"
#: 1-based dense row number that ties messages to rows.
RECORD_INDEX = "__record_index__"


class ConstraintError(ValueError):
    """A step's precondition does not hold."""


class MissingEntity(KeyError):
    """An entity that a step needs is not in the catalog."""

    def __str__(self) -> str:
        return f"missing entity {self.args[0]!r}"


class MissingReferenceData(MissingEntity):
    """Reference data that a step needs is not configured."""


@dataclass(frozen=True)
class Catalog(Mapping[str, DataFrame]):
    """Immutable mapping. ``references`` loads ``refdata_<name>`` on first use and keeps the handle."""

    entities: Mapping[str, DataFrame] = field(default_factory=dict)
    references: Callable[[str], DataFrame | None] | None = None
    _loaded: dict[str, DataFrame] = field(default_factory=dict, repr=False, compare=False)

    def __post_init__(self) -> None:
        for name in self.entities:
            _check_writable(name)

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.entities:
            return self.entities[name]
        if name.startswith(REFERENCE_PREFIX):
            if name not in self._loaded:
                found = self.references(name.removeprefix(REFERENCE_PREFIX)) if self.references else None
                if found is None:
                    raise MissingReferenceData(name)
                self._loaded[name] = found
            return self._loaded[name]
        raise MissingEntity(name)

    def __iter__(self) -> Iterator[str]:
        return iter(self.entities)

    def __len__(self) -> int:
        return len(self.entities)

    def put(self, name: str, frame: DataFrame) -> Catalog:
        _check_writable(name)
        return replace(self, entities={**self.entities, name: frame})

    def drop(self, *names: str) -> Catalog:
        for name in names:
            _check_writable(name)
        return replace(self, entities={k: v for k, v in self.entities.items() if k not in names})


def _check_writable(name: str) -> None:
    if name.startswith(REFERENCE_PREFIX):
        raise ConstraintError(f"reference data can't be changed: {name!r}")
