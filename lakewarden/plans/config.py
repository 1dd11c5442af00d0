"""The dataset document: JSON to dataclasses, with rule stores resolved and parameters merged."""

from __future__ import annotations

import json
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from lakewarden.operators.filters import DeferredFilter
from lakewarden.operators.steps import STEPS, Step
from lakewarden.plans.messages import Reporting, severity
from lakewarden.plans.rules import Rule
from lakewarden.plans.templating import render


class ConfigError(ValueError):
    """The dataset document is not usable."""


#: Names of fields in the document that differ from the steps' own.
_RENAMED = {"filter_rule": "expression"}


def build_step(spec: Mapping[str, Any]) -> Step:
    """A step from its JSON form. Unknown keys are an error, so that a misspelt option is not ignored."""
    spec = dict(spec)
    operation = spec.pop("operation", None)
    if operation not in STEPS:
        raise ConfigError(f"unknown operation {operation!r}")
    kind = STEPS[operation]
    if operation == "remove_entities" and "entities" in spec:
        spec["entity"] = spec.pop("entities")
    known = {f.name for f in fields(kind)}
    values = {}
    for key, value in spec.items():
        key = _RENAMED.get(key, key)
        if key in ("description", "agg_function"):
            continue
        if key not in known:
            raise ConfigError(f"operation {operation!r} has no option {key!r}")
        values[key] = tuple(value) if isinstance(value, list) else value
    try:
        return kind(**values)
    except TypeError as error:
        raise ConfigError(f"operation {operation!r}: {error}") from None


def build_filter(spec: Mapping[str, Any]) -> DeferredFilter:
    shown = spec.get("reporting_field")
    reporting = Reporting(
        emit=spec.get("emit") or severity(spec.get("failure_type", "record"), spec.get("is_informational", False)),
        code=spec.get("error_code"),
        message=spec.get("failure_message"),
        category=spec.get("category", "Bad value"),
        location=spec.get("error_location"),
        reporting_field=tuple(shown) if isinstance(shown, list) else shown,
        reporting_field_name=spec.get("reporting_field_name"),
        reporting_entity=spec.get("reporting_entity"),
    )
    return DeferredFilter(
        entity=spec["entity"], expression=spec["expression"], name=spec.get("name"), reporting=reporting,
        original_entity=spec.get("original_entity_override"),
    )


def _read(base: Path | str | None, name: str) -> str:
    """A document beside another one, or by its own path or URI."""
    place = name if base is None or "://" in name or name.startswith("/") else f"{str(base).rstrip('/')}/{name}"
    if "://" not in place:
        return Path(place).read_text()
    from pyspark.sql import SparkSession

    from lakewarden.sources.files import Files

    return Files(SparkSession.active()).read_text(place)


@dataclass(frozen=True)
class FieldSpec:
    """A field of a schema: a type name with arguments, or a nested schema; perhaps an array."""

    kind: str | None = None
    model: str | None = None
    arguments: Mapping[str, Any] = field(default_factory=dict)
    is_array: bool = False
    functions: Sequence[Mapping[str, Any]] = ()
    default: Any = None


@dataclass(frozen=True)
class SchemaSpec:
    fields: Mapping[str, FieldSpec]
    mandatory: frozenset[str] = frozenset()


@dataclass(frozen=True)
class DatasetSpec(SchemaSpec):
    """An entity: its schema, key fields, and how each file extension is read."""

    reporting_fields: tuple[str, ...] = ()
    readers: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)


def _field(spec: Any, types: Mapping[str, Any], seen: tuple[str, ...] = ()) -> FieldSpec:
    if isinstance(spec, str):
        spec = {"type": spec}
    if sum(key in spec for key in ("type", "model", "callable")) != 1:
        raise ConfigError(f"a field needs exactly one of type, model and callable: {spec!r}")
    shared = {"is_array": bool(spec.get("is_array")), "functions": tuple(spec.get("functions", ())), "default": spec.get("default")}
    if "model" in spec:
        return FieldSpec(model=spec["model"], **shared)
    if "callable" in spec:
        return FieldSpec(kind=spec["callable"], arguments=spec.get("constraints", {}), **shared)
    name = spec["type"]
    if name in types:
        if name in seen:
            raise ConfigError(f"type {name!r} is defined by itself")
        alias = _field(types[name], types, (*seen, name))
        return FieldSpec(alias.kind, alias.model, alias.arguments, alias.is_array or shared["is_array"], (*alias.functions, *shared["functions"]), shared["default"] or alias.default)
    return FieldSpec(kind=name, **shared)


@dataclass(frozen=True)
class Contract:
    datasets: Mapping[str, DatasetSpec]
    schemas: Mapping[str, SchemaSpec]
    error_details: Mapping[str, Mapping[str, Mapping[str, Any]]] = field(default_factory=dict)
    cache_originals: bool = False

    @classmethod
    def from_json(cls, document: Mapping[str, Any], base: Path | str | None = None) -> Contract:
        types = document.get("types", {})

        def schema(spec: Mapping[str, Any]) -> dict[str, Any]:
            return {"fields": {k: _field(v, types) for k, v in spec["fields"].items()}, "mandatory": frozenset(spec.get("mandatory_fields", ()))}

        details = document.get("error_details") or {}
        if isinstance(details, str):
            details = json.loads(_read(base, details))
        datasets = {
            name: DatasetSpec(**schema(spec), reporting_fields=_names(spec.get("reporting_fields") or spec.get("key_field")), readers=spec.get("reader_config", {}))
            for name, spec in document.get("datasets", {}).items()
        }
        schemas = {name: SchemaSpec(**schema(spec)) for name, spec in document.get("schemas", {}).items()}
        return cls(datasets, schemas, details, bool(document.get("cache_originals")))


def _names(value: Any) -> tuple[str, ...]:
    return () if not value else (value,) if isinstance(value, str) else tuple(value)


@dataclass(frozen=True)
class DatasetConfig:
    """Everything a run needs: contract, the program of rules, parameters and reference data."""

    contract: Contract
    rules: tuple[Rule, ...] = ()
    parameters: Mapping[str, Any] = field(default_factory=dict)
    reference_data: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    base: Path | str | None = None
    templating: str = "upfront"

    @classmethod
    def load(cls, path: str | Path) -> DatasetConfig:
        """From a local path, or by URI through the active session's file systems."""
        base = str(path).rsplit("/", 1)[0] if "://" in str(path) else Path(path).parent
        return cls.from_json(json.loads(_read(None, str(path))), base)

    @classmethod
    def from_json(cls, document: Mapping[str, Any], base: Path | str | None = None) -> DatasetConfig:
        program = document.get("transformations", {})
        stores: dict[str, Mapping[str, Any]] = {}
        for store in program.get("rule_stores", ()):  # a later store overrides an earlier one
            if store.get("store_type", "json") != "json":
                raise ConfigError(f"unknown rule store type {store['store_type']!r}")
            stores |= json.loads(_read(base, store["filename"])) if "filename" in store else store["rules"]
        rules = [
            _complex_rule(spec, stores, added) for spec, added in _with_earlier(program.get("complex_rules", ()))
        ]
        root = _rule("root", program, stores, {})
        return cls(
            Contract.from_json(document.get("contract", {}), base), (*rules, root), dict(program.get("parameters", {})),
            dict(program.get("reference_data", {})), base, program.get("templating_strategy", "upfront"),
        )


def _with_earlier(specs: Sequence[Mapping[str, Any]]):
    """Each spec with the names of those before it."""
    names: list[str] = []
    for spec in specs:
        yield spec, tuple(names)
        names.append(spec["rule_name"])


def _complex_rule(spec: Mapping[str, Any], stores: Mapping[str, Any], added: tuple[str, ...]) -> Rule:
    stored = _stored(spec["rule_name"], stores, "complex_rule")
    config = stored["rule_config"]
    for dependency in config.get("dependencies", stored.get("dependencies", ())):
        if dependency not in added:
            raise ConfigError(f"rule {spec['rule_name']!r} depends on {dependency!r}, which is not added before it")
    return _rule(spec["rule_name"], config, stores, {**stored.get("parameter_defaults", {}), **spec.get("parameters", {})})


def _stored(name: str, stores: Mapping[str, Any], kind: str) -> Mapping[str, Any]:
    if name not in stores:
        raise ConfigError(f"rule {name!r} is in no rule store")
    if stores[name].get("type") != kind:
        raise ConfigError(f"rule {name!r} is a {stores[name].get('type')!r}, not a {kind!r}")
    return stores[name]


def _rule(name: str, config: Mapping[str, Any], stores: Mapping[str, Any], parameters: Mapping[str, Any]) -> Rule:
    """Specs stay JSON in the rule, as they may hold templates; they are rendered and built when it is evaluated."""
    steps = list(config.get("rules", ()))
    filters = [resolve_filter(spec, stores) for spec in config.get("filters", ())]
    post = list(config.get("post_filter_rules", ()))
    if "sync" in steps:
        first = steps.index("sync")
        last = len(steps) - 1 - steps[::-1].index("sync")
        if any(step != "sync" for step in steps[first : last + 1]):
            raise ConfigError("sync steps must stand together")
        steps, post = steps[:first], steps[last + 1 :] + post
    return Rule(name, tuple(steps), tuple(filters), tuple(post), dict(parameters))


def resolve_filter(spec: Mapping[str, Any], stores: Mapping[str, Any], seen: tuple[str, ...] = ()) -> Mapping[str, Any]:
    """A stored filter with its parameters put in; other names are left for the rule's own parameters."""
    if "rule_name" not in spec:
        return spec
    name = spec["rule_name"]
    if name in seen:
        raise ConfigError(f"filter {name!r} refers to itself")
    if ignored := set(spec) - {"rule_name", "parameters"}:
        warnings.warn(f"keys beside rule_name are ignored in filter {name!r}: {sorted(ignored)}", stacklevel=2)
    stored = _stored(name, stores, "filter")
    inner = resolve_filter(stored.get("filter_config", stored.get("rule_config", {})), stores, (*seen, name))
    return render(inner, {**stored.get("parameter_defaults", {}), **spec.get("parameters", {})})
